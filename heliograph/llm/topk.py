"""Exact top-k by a bit-sliced index.

A block of rows holds its quantised vectors as bit slices: for every attribute (component, offset so that none is
negative) and every binary place, one bitmap over the block's rows. A query's components are written in signed binary
digits; each digit asks for an attribute's slices at its weight, as they are or complemented (whose constant is taken off
again). The slices of equal weight are added by bitmap arithmetic: full adders over words of 64 rows turn three bitmaps
into one of their weight and one of the next, until one bitmap of each weight is left: the bit slices of the score. The
top rows are then selected from the most significant score slice downward; rows that remain tied at the boundary are
resolved exactly, by id. Blocks give at most k rows a query each, and those are merged.

Blocks of queries and rows meet in the grid of the block matrix join: a stated query set against all rows, in blocks.
The index of a block is built once.

Defined cases: vectors null or with null or non-finite components take no part; zero vectors do. Components beyond 2^31
after scaling (``LARGE``) would need very many slices: their rows are scored apart, in integers of any size, as are
queries that hold such. A score beyond a long is ranked by its exact value and given as the largest (or smallest) long.
Unequal lengths: the shorter ends in zeros. Ties go to the smaller id. An id of several rows is asked once, with the
smallest of its vectors; as candidates its rows count one by one, and none is a candidate of its own id's query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import ann

QUERY_BLOCK = 512
ROW_BLOCK = 16_384
SCALE = 1024
LARGE = float(1 << 31)
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


class Slices:
    """Bit slices of one block: a bitmap, 64 rows a word, for each attribute and place; rows are in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.n, self.width = values.shape
        self.words = (self.n + 63) // 64
        self.low = values.min(0) if self.n else np.zeros(self.width, np.int64)
        span = (values.max(0) - self.low) if self.n else self.low
        self.places = np.array([int(s).bit_length() for s in span], np.int64)
        self.first = np.cumsum(self.places) - self.places
        self.slices = np.zeros((int(self.places.sum()), self.words), np.uint64)
        for j, (w, at) in enumerate(zip(self.places.tolist(), self.first.tolist())):
            if w:
                bits = np.unpackbits(np.ascontiguousarray(values[:, j] - self.low[j]).view(np.uint8).reshape(self.n, 8), axis=1, bitorder="little")
                self.slices[at : at + w] = self.bitmaps(bits[:, :w].T)
        self.all = self.bitmaps(np.ones((1, self.n), np.uint8))[0]

    def bitmaps(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 64), np.uint8)
        out[:, : self.n] = bits
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def values(self) -> list[list[int]]:
        """The rows back from their slices."""
        out = np.tile(self.low, (self.n, 1))
        for j, (w, at) in enumerate(zip(self.places.tolist(), self.first.tolist())):
            for p in range(w):
                out[:, j] += np.unpackbits(self.slices[at + p].view(np.uint8), bitorder="little")[: self.n].astype(np.int64) << p
        return out.tolist()

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of a non-negative sum, and what to add to it for the inner product."""
        q = q[: self.width]
        low, places = self.low[: len(q)], self.places[: len(q)]
        constant = sum(x * y for x, y in zip(q.tolist(), low.tolist()))
        # Signed digits: no two neighbours differ from 0.
        half = np.abs(q) >> 1
        more = np.abs(q) + half
        plus, minus = more & ~half, half & ~more
        plus, minus = np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)
        idx, level, turned = [], [], []
        for digits, sign in ((plus, 1), (minus, -1)):
            bits = np.unpackbits(np.ascontiguousarray(digits).view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
            bits[places == 0] = 0
            j, b = np.nonzero(bits)
            w = places[j]
            within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            idx.append(np.repeat(self.first[j], w) + within)
            level.append(np.repeat(b, w) + within)
            turned.append(np.full(len(within), sign < 0))
            if sign < 0:
                constant -= sum(((1 << int(x)) - 1) << int(y) for x, y in zip(w.tolist(), b.tolist()))
        idx, level, turned = map(np.concatenate, (idx, level, turned))
        order = np.argsort(level, kind="stable")
        idx, level, turned = idx[order], level[order], turned[order]
        total: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        top = int(level[-1]) + 1 if len(level) else 0
        cuts = np.searchsorted(level, np.arange(top + 1)).tolist()
        while len(total) < top or carries:
            p = len(total)
            x = np.zeros((0, self.words), np.uint64)
            if p < top:
                x = self.slices[idx[cuts[p] : cuts[p + 1]]]
                x[turned[cuts[p] : cuts[p + 1]]] ^= self.all
            x = np.concatenate([x, *carries])
            carries = []
            while len(x) > 1:
                if len(x) == 2:
                    carries.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
                else:
                    t = len(x) // 3
                    a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    carries.append((a & b) | (ab & c))
                    x = np.concatenate([ab ^ c, x[3 * t :]])
            total.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
        return total, constant

    def top(self, q: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """(inner product, id) of the k best rows."""
        if not self.n:
            return []
        total, constant = self.scores(q)
        tied = self.all.copy()
        for at in range(int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, "right"))):
            tied[at // 64] &= ~np.uint64(1 << (at % 64))
        best = np.zeros(self.words, np.uint64)
        for s in reversed(total):
            more = best | (tied & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied = tied & s
            else:
                best = more
                tied = tied & ~s
                if n == k:
                    tied = np.zeros(self.words, np.uint64)
                    break
        rows = self.rows(best)
        room = k - len(rows)
        if room > 0:  # the boundary: equal scores, so the smallest ids
            rows = np.concatenate([rows, self.rows(tied)[:room]])
        w, b = rows // 64, (rows % 64).astype(np.uint64)
        score = [constant] * len(rows)
        for p, s in enumerate(total):
            score = [x + (int(bit) << p) for x, bit in zip(score, (s[w] >> b) & np.uint64(1))]
        return list(zip(score, self.ids[rows].tolist()))

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def _whole(m: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * m) as integers where all of a row are within LARGE, and which rows aren't."""
    with np.errstate(over="ignore"):
        y = np.floor(m * scale)
    large = (np.abs(y) > LARGE).any(1)
    return np.where(large[:, None], 0, y).astype(np.int64), large


def _big(row: np.ndarray, scale: int) -> list[int]:
    """The same for one row, in integers of any size."""
    return [int(np.floor(x * scale)) if abs(x) < 1e300 else int(x) * scale for x in row.tolist()]


def _product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))


def quantised(vectors: DataFrame) -> DataFrame:
    """id and vector of the rows that take part; the index itself takes floor(scale * x), in integers of any size."""
    return ann.usable(vectors, zero=True)


def search(queries: DataFrame, rows: DataFrame, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of the largest inner product of floor(scale * v) with each query; both (id, v)."""

    def encode_query(ids, m):
        whole, large = _whole(m, scale)
        return ids, whole, {int(i): _big(m[i], scale) for i in np.flatnonzero(large)}

    def encode_row(ids, m):
        whole, large = _whole(m, scale)
        apart = [(int(ids[i]), _big(m[i], scale)) for i in np.flatnonzero(large)]
        return Slices(ids[~large], whole[~large]), apart

    def batch(ids, best):
        flat = [(i, j, -s) for i, own in zip(ids.tolist(), best) for s, j in own]
        score = [max(_MIN, min(_MAX, s)) for _, _, s in flat]
        # Beyond a long: the exact value, in bytes of the same order.
        big = [(s + (1 << 2300)).to_bytes(289, "big") if s in (_MIN, _MAX) or not _MIN < s < _MAX else None for _, _, s in flat]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array(score, pa.int64()), pa.array(big, pa.binary())], ["query_id", "vec_id", "score", "big"])

    def step(cells):
        now, ids, best = None, None, None
        for key, (asked, whole, large), (index, apart) in cells:
            if key != now:
                if now is not None:
                    yield batch(ids, best)
                now, ids, best = key, asked, [[] for _ in asked]
            for n, own in enumerate(asked.tolist()):
                q = large.get(n)
                if q is None:
                    found = index.top(whole[n], k, own)
                else:
                    found = [(_product(q, v), i) for i, v in zip(index.ids.tolist(), index.values()) if i != own]
                if apart:
                    q = whole[n].tolist() if q is None else q
                    found += [(_product(q, v), i) for i, v in apart if i != own]
                best[n] = heapq.nsmallest(k, best[n] + [(-s, i) for s, i in found])
        if now is not None:
            yield batch(ids, best)

    found = ann.joined(queries, rows, QUERY_BLOCK, ROW_BLOCK, encode_query, encode_row, step, "query_id long, vec_id long, score long, big binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("big"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v.filter("id % 100 = 0"), v, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
