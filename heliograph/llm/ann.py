"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks with their int8 codes, scales and rounding errors, once. Queries' blocks and groups of
rows' blocks form a grid, and each cell is one key of an equi-join (a stated query set against all rows, in blocks).
A tile is one matrix product of the int8 codes; products of small integers are exact in float32 over SPAN components, and
longer vectors are summed in double precision span by span. With per-vector scales s the inner product q.c lies within
|q - s q8|.|c| + |s q8|.|c - s c8| of s s' (q8.c8), so a lower bound of the k-th best is known, and only pairs whose upper
bound reaches it are recomputed, in double precision on the original vectors. A tile's survivors are cut to k per query,
a cell's tiles are merged by heaps, and a window over the cells of a query gives the k nearest. Nothing is approximate
in the result.

Defined cases: vectors null, zero or with null or non-finite components take no part, as query or candidate. Vectors
of unequal length are compared as if the shorter ended in zeros. Ties go to the smaller id. An id of several rows is
asked once, with the smallest of its vectors; as candidates its rows count one by one, and none is a candidate of its
own id's query. A score that overflows to no number at all counts as the smallest.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import common as C

QUERY_BLOCK = 4096
ROW_BLOCK = 8192
CELL_ROWS = 16_384  # rows of a cell of the grid
STRIPE = 128  # queries of a tile that are multiplied at once
SPAN = 1024  # 127^2 * SPAN < 2^24


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = False) -> DataFrame:
    """id and vector (array of double) of the rows that take part; zero: zero vectors do too."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite)
    return v if zero else v.filter(F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Lists as rows of one matrix of doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    lens = np.asarray(column.value_lengths()).astype(np.int64)
    width = int(lens.max()) if len(lens) else 0
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices, of one width."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def joined(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int, encode_query, encode_row, step, schema: str) -> DataFrame:
    """step over the cells of the grid of queries and rows, both (id, v).

    encode_query and encode_row make anything of (ids, matrix), once for each block; step gets an iterator of cells, each
    an iterator of (encoded queries, encoded rows) with the same queries, and yields record batches of the schema.
    """
    asked = C.written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    numbers = max(1, math.ceil(asked.count() / query_block))

    def pack_queries(key, table):
        data = pickle.dumps(encode_query(table["id"].to_numpy(), matrix(table["v"])))
        return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "q_data": pa.array([data], pa.binary())})

    def pack_rows(batches):
        ids, parts, held = [], [], 0

        def packed():
            width = max(p.shape[1] for p in parts)
            m = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
            i = np.concatenate(ids)
            number = int((C.mix(i.view(np.uint64)).sum() >> np.uint64(2)).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(i)], pa.int64()), pa.array([pickle.dumps(encode_row(i, m))], pa.binary())], ["hash", "n", "data"])

        for b in batches:
            i, m = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            at = 0
            while at < len(i):
                take = min(row_block - held, len(i) - at)
                ids.append(i[at : at + take])
                parts.append(m[at : at + take])
                held += take
                at += take
                if held == row_block:
                    yield packed()
                    ids, parts, held = [], [], 0
        if held:
            yield packed()

    number = F.pmod(F.xxhash64("id"), F.lit(numbers)).cast("int")
    q = C.written(asked.groupBy(number.alias("q")).applyInArrow(pack_queries, "q int, q_data binary"), "query-blocks")
    # Blocks of rows are packed where they lie, and written: what a cell holds must not change when a task runs again.
    r = C.written(rows.select("id", "v").mapInArrow(pack_rows, "hash long, n long, data binary"), "row-blocks")
    groups = max(1, math.ceil((r.agg(F.sum("n")).first()[0] or 0) / CELL_ROWS))
    r = r.select(F.pmod("hash", F.lit(groups)).cast("int").alias("g"), "data", F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))).alias("q"))
    q = q.select("q", "q_data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    met = r.join(q, ["q", "g"]).select("q", "g", "q_data", "data")

    def run(batches):
        def tiles():
            for b in batches:
                for i in range(b.num_rows):
                    yield (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i], b.column(3)[i]

        def cells():
            """Rows of one cell stand together: the join has sorted (or hashed) them by its keys; if not, a cell comes in parts."""
            now, held = None, None
            for key, q_data, data in tiles():
                if key != now:
                    now, held = key, pickle.loads(q_data.as_py())
                yield key, held, pickle.loads(data.as_py())

        yield from step(cells())
        C.trim()

    return met.mapInArrow(run, schema)


def int8(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the scale of each row, the norm of each row's rounding error, and of the row."""
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(m).max(1, initial=0.0) / 127.0
        scale[scale == 0] = 1.0
        codes = np.rint(m / scale[:, None])
        return codes.astype(np.int8), scale, np.sqrt(((m - codes * scale[:, None]) ** 2).sum(1)), np.sqrt((m * m).sum(1))


def coded(ids: np.ndarray, m: np.ndarray) -> tuple:
    """A block: ids, codes, scales, errors, norms, and the vectors (in single precision where that is exact)."""
    with np.errstate(over="ignore"):
        single = m.astype(np.float32)
    return ids, *int8(m), single if (single == m).all() else m


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component in order, so that equal vectors have equal products."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j].astype(np.float64) * b[:, j]
    return np.where(np.isnan(total), -np.inf, total)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product of codes, exact."""
    total = 0.0
    for at in range(0, max(1, a.shape[1]), SPAN):
        total = total + (a[:, at : at + SPAN].astype(np.float32) @ b[:, at : at + SPAN].astype(np.float32).T).astype(np.float64)
    return total


def tile(queries: tuple, rows: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one tile: query row, id, score; by query row, best first."""
    (qi, q8, qs, qe, qn, q), (ci, c8, cs, ce, cn, c) = queries, rows
    q8, c8 = alike(q8, c8)
    q, c = alike(q, c)
    found = []
    for lo in range(0, len(qi), STRIPE):
        at = slice(lo, lo + STRIPE)
        with np.errstate(over="ignore", invalid="ignore"):
            near = products(q8[at], c8) * qs[at, None] * cs
            most = qn[at, None] + qe[at, None]
            bound = qe[at, None] * cn + most * ce + 1e-9 * (most * (cn + ce) + 1e-300)
            low = near - bound
            doubt = ~np.isfinite(near + bound)  # overflow: always recomputed
            low[doubt] = -np.inf
            own = qi[at, None] == ci
            low[own] = -np.inf
            keep = min(k, len(ci))
            floor = np.partition(low, len(ci) - keep, axis=1)[:, len(ci) - keep]
            row, col = np.nonzero((((near + bound) >= floor[:, None]) | doubt) & ~own)
        score = np.empty(len(row))
        for s in range(0, len(row), 1 << 14):
            score[s : s + (1 << 14)] = exact(q[lo + row[s : s + (1 << 14)]], c[col[s : s + (1 << 14)]])
        order = np.lexsort((ci[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[top] + lo, ci[col[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of the largest inner product with each query; both (id, v)."""

    def batch(ids: np.ndarray, best: list[list]) -> pa.RecordBatch:
        flat = [(i, j, -s) for i, own in zip(ids.tolist(), best) for s, j in own]
        q, v, s = zip(*flat) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    def step(cells):
        now, ids, best = None, None, None
        for key, asked, block in cells:
            if key != now:
                if now is not None:
                    yield batch(ids, best)
                now, ids, best = key, asked[0], [[] for _ in asked[0]]
            row, found, score = tile(asked, block, k)
            cuts = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
            pairs = list(zip((-score).tolist(), found.tolist()))
            for n in range(len(ids)):
                if cuts[n] < cuts[n + 1]:
                    best[n] = heapq.nsmallest(k, best[n] + pairs[cuts[n] : cuts[n + 1]])
        if now is not None:
            yield batch(ids, best)

    found = joined(queries, rows, QUERY_BLOCK, ROW_BLOCK, coded, coded, step, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v.filter("id % 20 = 0"), v, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
