"""Merging ranked lists: weighted reciprocal rank fusion, query variants, routing weights, interleaving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators.lexical import LexicalIndex, top_k


def rrf(sources: dict[str, DataFrame], k: int = 5, k_rrf: int = 60, weights: dict[str, float | Column] | None = None, tie: str = "chunk_id") -> DataFrame:
    """Fuses ranked lists (query_id, chunk_id, rank) by the sum of weight / (k_rrf + rank).

    Sources of weight 0 or less aren't scanned; a weight may also be a Column of the list (routing). Ties: by chunk_id,
    or with tie="first_seen" by the order of sources and ranks. Adds rank_<source> for every source, and provenance.
    """
    weights = weights or {}
    live = {n: s for n, s in sources.items() if not (isinstance(weights.get(n, 1.0), (int, float)) and weights.get(n, 1.0) <= 0)}
    if not live:
        raise ValueError("every source has weight 0")
    parts = []
    for i, (name, s) in enumerate(live.items()):
        w = weights.get(name, 1.0)
        w = w if isinstance(w, Column) else F.lit(float(w))
        parts.append(s.select("query_id", "chunk_id", "rank", F.lit(i).alias("ord"), F.lit(name).alias("source"), w.cast("double").alias("w")))
    every = reduce(DataFrame.unionByName, parts).filter("w > 0")
    marks = [F.min(F.when(F.col("source") == n, F.col("rank"))).alias(f"rank_{n}") for n in live]
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") / (F.lit(k_rrf) + F.col("rank"))).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "source"))), lambda x: x["source"]), "+").alias("provenance"),
        F.min(F.struct("ord", "rank")).alias("seen"),
        *marks,
    )
    ties = ("seen", "chunk_id") if tie == "first_seen" else ("chunk_id",)
    return top_k(fused, k, "query_id", *ties).select("query_id", "chunk_id", "rank", "score", "provenance", *[f"rank_{n}" for n in live])


def multi_query(variants: DataFrame, ranked: DataFrame, k: int = 5, k_rrf: int = 60) -> DataFrame:
    """Fuses the lists of a question's variants with weight 1. variants(query_id, variant_id, ord), ranked(query_id = variant_id, chunk_id, rank)."""
    v = variants.select(F.col("query_id").alias("question_id"), F.col("variant_id").alias("query_id"), "ord")
    every = ranked.select("query_id", "chunk_id", "rank").join(v, "query_id")
    fused = every.groupBy(F.col("question_id").alias("query_id"), "chunk_id").agg(F.sum(1.0 / (k_rrf + F.col("rank"))).alias("score"), F.min(F.struct("ord", "rank")).alias("seen"))
    return top_k(fused, k, "query_id", "seen", "chunk_id").select("query_id", "chunk_id", "rank", "score")


def expand(queries: DataFrame, variants: DataFrame, most: int = 3) -> DataFrame:
    """The question itself, then its cleaned distinct variants, at most so many: query_id, variant_id, ord, query. variants(query_id, lines array)."""
    lines = F.filter(F.transform(F.col("lines"), lambda x: F.trim(T.clean_variant(x))), lambda x: x != "")
    every = queries.join(variants, "query_id", "left").select("query_id", F.array_distinct(F.concat(F.array("query"), F.coalesce(F.slice(F.array_except(F.array_distinct(lines), F.array("query")), 1, most), F.array().cast("array<string>")))).alias("q"))
    rows = every.select("query_id", F.posexplode("q").alias("ord", "query"))
    return rows.select("query_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("ord").cast("string")).alias("variant_id"), "ord", "query")


QUOTED = '“[^”]{3,}”|"[^"]{3,}"'
IDENTIFIER = r"(?U)\b(?=[.\w-]*[A-Za-z])(?=[.\w-]*\d)[.\w-]{3,}\b|\b[A-Z][A-Z]+[_-]\w+\b"
QUESTION = r"(?i)^\s*(?:what|which|when|where|who|why|how|is|are|can|do|does)\b"


def route(queries: DataFrame, index: LexicalIndex | None = None, lexical: float = 2.0, semantic: float = 1.5, rare_idf: float = 6.0, long_terms: int = 6) -> DataFrame:
    """query_id, w_bm25, w_vector, reason: the first rule that fits. The rare term rule needs an index."""
    q = queries.select("query_id", "query")
    asked = index.sent(q) if index is not None and index.analyzer == "english" else None
    if asked is not None:
        q = q.join(F.broadcast(index.rarest(asked, q)), "query_id", "left")
    elif index is not None:
        terms = q.select("query_id", F.explode(T.english(F.col("query"))).alias("term")).distinct()
        stats = index.term_stats(index.postings(terms))
        best = terms.join(stats, "term").groupBy("query_id").agg(F.max("idf").alias("best"))
        q = q.join(best, "query_id", "left")
    else:
        q = q.withColumn("best", F.lit(None).cast("double"))
    text = F.col("query")
    quoted, identifier = text.rlike(QUOTED), text.rlike(IDENTIFIER)
    rare = F.round(F.coalesce("best", F.lit(0.0)), 9) >= rare_idf
    question = text.rlike(QUESTION) & (F.size(T.content_tokens(text)) >= long_terms)
    reason = F.when(quoted, "quoted phrase").when(identifier, "identifier").when(rare, F.format_string("rare term (idf %.1f)", "best")).when(question, "long natural-language question").otherwise("balanced")
    return q.select("query_id", F.when(quoted | identifier | rare, lexical).otherwise(1.0).alias("w_bm25"), F.when(~(quoted | identifier | rare) & question, semantic).otherwise(1.0).alias("w_vector"), reason.alias("reason"))


def interleave(ranked: DataFrame, limit: Column | int) -> DataFrame:
    """Round-robin over a question's groups, a chunk once: (question_id, group_no, chunk_id, rank) -> (question_id, chunk_id, place)."""
    order = ("rank", "group_no", "chunk_id")
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy(*order))).filter("n = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    return placed.filter(F.col("place") <= limit).select("question_id", "chunk_id", "place")
