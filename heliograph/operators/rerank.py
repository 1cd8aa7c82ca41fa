"""Second-stage rankers over a pool of candidates (query_id, chunk_id, rank, score)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators.lexical import top_k


def truncate(pool: DataFrame, k: int) -> DataFrame:
    return pool.filter(F.col("rank") <= k)


def jaccard(pool: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """By token set overlap of query and text; ties in the pool's order."""
    both = pool.select("query_id", "chunk_id", F.col("rank").alias("was")).join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    both = both.select("query_id", "chunk_id", "was", F.array_distinct(T.tokens(F.col("query"))).alias("a"), F.array_distinct(T.tokens(F.col("text"))).alias("b"))
    score = T.jaccard(F.col("a"), F.col("b"))
    return top_k(both.select("query_id", "chunk_id", "was", score.alias("score")), k, "query_id", "was").select("query_id", "chunk_id", "rank", "score")


def scored_by(pool: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """By a batch scoring function of (query, text), such as a cross-encoder; it runs as a pandas UDF."""
    both = pool.select("query_id", "chunk_id", F.col("rank").alias("was")).join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return score(q, t)

    return top_k(both.withColumn("score", F.pandas_udf(run, "double")("query", "text")), k, "query_id", "was").select("query_id", "chunk_id", "rank", "score")


def normalized_scores(pool: DataFrame) -> DataFrame:
    """Scores min-max scaled within each query; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return pool.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def mmr(pool: DataFrame, query_vectors: DataFrame | None, vectors: DataFrame, k: int, weight: float = 0.7, relevance: str = "embedding") -> DataFrame:
    """Maximal marginal relevance: greedy picks of weight * relevance - (1 - weight) * largest similarity to a pick.

    A query's pool (a bounded candidate list) is one group. relevance: embedding (cosine with the query) or fused (the
    pool's scores, min-max scaled). vectors(id, v); ties go to the earlier candidate.
    """
    p = normalized_scores(pool).join(vectors.select(F.col("id").alias("chunk_id"), "v"), "chunk_id")
    if relevance == "embedding":
        p = p.join(query_vectors.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    else:
        p = p.withColumn("qv", F.col("v"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        m = np.array(pdf.v.tolist(), float)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = np.nan_to_num(m / np.sqrt((m * m).sum(1, keepdims=True)))
            q = np.array(pdf.qv[0], float)
            q = np.nan_to_num(q / np.sqrt((q * q).sum()))
        rel = np.clip(m @ q, -1, 1) if relevance == "embedding" else pdf.score.to_numpy()
        near, left, out = np.zeros(len(m)), np.ones(len(m), bool), []
        for n in range(min(k, len(m))):
            s = np.round(weight * rel - (1 - weight) * near, 12)
            best = int(np.flatnonzero(left)[np.argmax(s[left])])
            out.append((best, s[best]))
            left[best] = False
            sims = np.clip(m @ m[best], -1, 1)
            near = sims if n == 0 else np.maximum(near, sims)
        i = [b for b, _ in out]
        return pd.DataFrame({"query_id": pdf.query_id[i].to_numpy(), "chunk_id": pdf.chunk_id[i].to_numpy(), "rank": np.arange(1, len(i) + 1, dtype=np.int32), "score": [s for _, s in out]})

    kinds = dict(pool.dtypes)
    return p.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank int, score double")
