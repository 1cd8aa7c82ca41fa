"""Dense retrieval: exact cosine in blocks, int8 and binary codes with rescoring, semantic cache probes.

Queries meet blocks of rows in matrix products; single pairs of vectors are never rows of a join, and only the k best of
each query leave a product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import vectors as V
from heliograph.operators import local
from heliograph.operators.lexical import RANK_DECIMALS, top_k

BLOCK = 1024
SENT_CELLS = 4_000_000


def fit_ranges(rows: DataFrame) -> DataFrame:
    """One row of arrays low, step and mean over all dimensions; rows(v)."""
    d = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    step = F.greatest((F.col("hi") - F.col("lo")) / 255.0, F.lit(1e-12))
    packed = d.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", step.alias("step"), "mean"))).alias("a"))
    return packed.select(F.transform("a", lambda x: x["lo"]).alias("low"), F.transform("a", lambda x: x["step"]).alias("step"), F.transform("a", lambda x: x["mean"]).alias("mean"))


def hashing_vectors(rows: DataFrame, dims: int = 128) -> DataFrame:
    """id, v of rows(id, text): token counts by crc32 bucket, L2-normalized; a text without tokens is a zero vector."""
    return local.hashed(rows, dims)


def _blocks(rows: DataFrame, prefix: str, size: int) -> DataFrame:
    """Blocks of ids and vectors as arrays; rows(id, v)."""
    groups = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-_count(rows) // size))))
    return rows.groupBy(groups.alias(f"{prefix}block")).agg(F.collect_list(F.struct("id", "v")).alias("a")).select(f"{prefix}block", F.transform("a", lambda x: x["id"]).alias(f"{prefix}ids"), F.transform("a", lambda x: x["v"]).alias(f"{prefix}v"))


def _count(rows: DataFrame) -> int:
    return rows.count()


def _vectors(ids: pa.Array, vectors: pa.Array, score: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (unit length for cosine; a zero vector stays one) of an Arrow column of lists of one length."""
    n = len(ids)
    m = np.asarray(vectors.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    if score == "cosine" and n:
        with np.errstate(divide="ignore", invalid="ignore"):
            m = np.nan_to_num(m / np.sqrt((m * m).sum(1, keepdims=True)))
    return np.asarray(ids.to_numpy(zero_copy_only=False), np.int64), m


def _tile(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, score: str, exclude_self: bool, threshold: float | None) -> pa.RecordBatch:
    """The k best rows of each query in one tile; by rounded score, then id."""
    s = q @ c.T
    if score == "hamming":
        s = 1 - 2 * (q.sum(1)[:, None] + c.sum(1) - 2 * s) / q.shape[1]
    if score == "cosine":
        s = np.clip(s, -1, 1)
    r = np.round(s, RANK_DECIMALS)
    if exclude_self:
        r[qi[:, None] == ci] = -np.inf
    if threshold is not None:
        r[s < threshold] = -np.inf
    keep = min(k, len(ci))
    floor = np.partition(r, len(ci) - keep, axis=1)[:, len(ci) - keep]
    row, col = np.nonzero((r >= floor[:, None]) & np.isfinite(r))
    order = np.lexsort((ci[col], -r[row, col], row))
    row, col = row[order], col[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[top], col[top]
    return pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(ci[col]), pa.array(s[row, col])], ["query_id", "chunk_id", "score"])


FOUND = "query_id long, chunk_id long, score double"


def block_search(queries: DataFrame, rows: DataFrame, k: int, score: str = "cosine", exclude_self: bool = True, threshold: float | None = None) -> DataFrame:
    """query_id, chunk_id, rank, score of each query's k best rows; both sides (id, v). score: cosine, dot or hamming (0/1 vectors).

    Queries of at most SENT_CELLS numbers in all are sent to where the rows are, and nothing but results is shuffled;
    more are packed into blocks that meet blocks of rows by an equi-join.
    """
    size = queries.agg(F.sum(F.size("v")).alias("n")).first()[0] or 0
    if size <= SENT_CELLS:
        qi, q = _sent(queries, score)

        def tiles(batches):
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    ci, c = _vectors(part.column(0), part.column(1), score)
                    for at in range(0, len(qi), BLOCK):
                        yield _tile(qi[at : at + BLOCK], q[at : at + BLOCK], ci, c, k, score, exclude_self, threshold)

        found = rows.select(F.col("id").cast("long"), "v").mapInArrow(tiles, FOUND)
    else:
        q, c = _blocks(queries, "q", BLOCK), _blocks(rows, "c", 4 * BLOCK)
        pairs = c.join(q.select("qblock")).join(q, "qblock")  # each block of rows once per block of queries

        def joined(batches):
            for b in batches:
                for i in range(b.num_rows):
                    x = [b.column(j)[i].values for j in range(4)]
                    yield _tile(*_vectors(x[0], x[1], score), *_vectors(x[2], x[3], score), k, score, exclude_self, threshold)

        found = pairs.select("qids", "qv", "cids", "cv").mapInArrow(joined, FOUND)
    return top_k(found, k).select("query_id", "chunk_id", "rank", "score")


def _sent(queries: DataFrame, score: str) -> tuple[np.ndarray, np.ndarray]:
    rows = queries.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return _vectors(rows["id"].combine_chunks(), rows["v"].combine_chunks(), score)


def int8_codes(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (id, v) with the vectors that their int8 codes stand for (a score against them is bias plus scaled codes)."""
    coded = rows.crossJoin(F.broadcast(ranges.select("low", "step")))  # one row of ranges
    code = V.int8_code(F.col("v"), F.col("low"), F.col("step"))
    return coded.select("id", code.alias("code"), F.zip_with(F.zip_with(code, "step", lambda c, s: c * s), "low", lambda x, lo: x + lo).alias("v"))


def binary_codes(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (id, v) with one 0 or 1 per dimension: whether x exceeds the mean."""
    coded = rows.crossJoin(F.broadcast(ranges.select("mean")))
    return coded.select("id", F.zip_with("v", "mean", lambda x, m: F.when(F.round(x - m, 12) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("v"))


def rescored(shortlist: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """A shortlist's exact cosines, and the k best of them."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = rows.select(F.col("id").alias("chunk_id"), F.col("v").alias("cv"))
    both = shortlist.select("query_id", "chunk_id").join(q, "query_id").join(c, "chunk_id")
    return top_k(both.select("query_id", "chunk_id", V.cosine(F.col("qv"), F.col("cv")).alias("score")), k).select("query_id", "chunk_id", "rank", "score")


def unit(rows: DataFrame) -> DataFrame:
    return rows.select("id", V.normalized(F.col("v")).alias("v"))


def quantized_search(queries: DataFrame, rows: DataFrame, k: int, mode: str = "int8", rescore_factor: int = 4, keep_full: bool = True) -> DataFrame:
    """Search over codes of unit vectors, then exact scores of k * rescore_factor candidates (none with keep_full false)."""
    u, q = unit(rows), unit(queries)
    ranges = fit_ranges(u)
    pool = k * rescore_factor if keep_full else k
    if mode == "int8":
        found = block_search(q, int8_codes(u, ranges), pool, "dot")
    else:
        found = block_search(binary_codes(q, ranges), binary_codes(u, ranges), pool, "hamming")
    return rescored(found, q, u, k) if keep_full else found


def cache_probe(queries: DataFrame, entries: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Per query the most similar entry that reaches the threshold: query_id, chunk_id, rank, score."""
    return block_search(queries, entries, 1, "cosine", threshold=threshold)


def dense_filter(rows: DataFrame, condition: Column) -> DataFrame:
    """A filter before the ranking."""
    return rows.filter(condition)
