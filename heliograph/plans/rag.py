"""Retrieval pipelines as one lazy plan over a table of queries: route, search, fuse, rerank, screen, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators import citations, dense, fusion, graph, guardrails, hooks, rerank
from heliograph.operators.lexical import K1, B, LexicalIndex, sparse_search
from heliograph.session import written

Ranker = Callable[[DataFrame, int, DataFrame | None], DataFrame]


def bm25_ranker(index: LexicalIndex, k1: float = K1, b: float = B) -> Ranker:
    return lambda queries, k, keep: index.bm25(queries, k, k1, b, keep)


def sparse_ranker(index: LexicalIndex) -> Ranker:
    return lambda queries, k, keep: sparse_search(index, queries, k, keep)


def hashing_ranker(chunks: DataFrame, dims: int = 128) -> Ranker:
    """Cosine of hashing embeddings of the texts; needs integer ids."""
    rows = dense.hashing_vectors(chunks.select(F.col("chunk_id").alias("id"), "text"), dims)

    def run(queries: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
        some = rows if keep is None else rows.join(keep.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        q = dense.hashing_vectors(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), dims)
        return dense.block_search(q, some, k, "cosine", exclude_self=False)

    return run


def graph_ranker(chunks: DataFrame) -> Ranker:
    """Diffusion over the entity graph; a query that names no usable entity starts from those that hold one of its words."""
    found = graph.mentions(chunks)
    n = chunks.agg(F.count("*").alias("n"))

    def run(queries: DataFrame, k: int, keep: DataFrame | None) -> DataFrame:
        return graph.search(found, n, lambda stats: graph.query_seeds(queries, stats), k, keep)

    return run


@dataclass
class Pipeline:
    """chunks(chunk_id, doc_id, text, ...), named rankers and how to combine them.

    weights: per ranker; a router replaces those of the rankers "bm25" and "vector" query by query.
    """

    chunks: DataFrame
    rankers: dict[str, Ranker]
    weights: dict[str, float] = field(default_factory=dict)
    k_rrf: int = 60
    router: Callable[[DataFrame], DataFrame] | None = None
    reranker: str | None = None  # jaccard, or none
    action: str | None = None  # of the guardrails: flag, sanitize, drop; or none
    generate: Callable | None = None  # (questions, lists of contexts) -> answers, by batches; else answers are extractive
    spotlight: bool = False  # prompts mark their contexts as untrusted data

    def search(self, queries: DataFrame, k: int = 5, pool: int = 20, keep: Column | None = None, mode: str = "hybrid") -> DataFrame:
        """query_id, chunk_id, rank, score, provenance. mode: hybrid, or a ranker's name for that one alone."""
        some = None if keep is None else self.chunks.filter(keep).select("chunk_id")
        pool = max(k, pool)
        if mode != "hybrid":
            return self.rankers[mode](queries, k, some).withColumn("provenance", F.lit(mode))
        lists = {n: r(queries, pool, some) for n, r in self.rankers.items() if self.weights.get(n, 1.0) > 0}
        weights: dict = dict(self.weights)
        if self.router:
            routed = self.router(queries).select("query_id", "w_bm25", "w_vector")
            for n in ("bm25", "vector"):
                if n in lists:
                    lists[n] = lists[n].join(routed, "query_id")
                    weights[n] = F.col(f"w_{n}") * float(self.weights.get(n, 1.0))
        found = fusion.rrf(lists, pool, self.k_rrf, weights)
        if self.reranker == "jaccard":
            return rerank.jaccard(found, queries, self.chunks, k).withColumn("provenance", F.lit("rerank:jaccard"))
        return found.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "provenance")

    def retrieve(self, queries: DataFrame, k: int = 5, pool: int = 20, keep: Column | None = None, mode: str = "hybrid") -> DataFrame:
        """The search with texts, screened by the guardrails (dropped contexts aren't refilled)."""
        found = self.search(queries, k, pool, keep, mode).join(self.chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
        return found if self.action is None or mode != "hybrid" else guardrails.screen(found, self.action)

    def answer(self, queries: DataFrame, k: int = 5, pool: int = 20, keep: Column | None = None) -> DataFrame:
        """query_id, query, prompt, answer, chunk_ids."""
        contexts = written(self.retrieve(queries, k, pool, keep))
        listed = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("c"))
        both = queries.join(listed, "query_id", "left")
        texts = F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>"))
        if self.generate:
            both = both.withColumn("answer", hooks.generate(F.col("query"), texts, self.generate))
        else:
            both = both.join(citations.extractive(queries, contexts), "query_id")
        prompt = F.concat_ws("\n\n", T.spotlight(texts), F.concat(F.lit("Question: "), F.col("query"))) if self.spotlight else T.prompt(F.col("query"), texts)
        return both.select("query_id", "query", prompt.alias("prompt"), "answer", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))

    def events(self, queries: DataFrame, k: int = 5, pool: int = 20, keep: Column | None = None) -> DataFrame:
        """query_id, n, type, text: each answer as its client gets it: the contexts (as JSON), its tokens, then done with the whole."""
        a = self.answer(queries, k, pool, keep)
        event = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
        contexts = F.to_json(F.coalesce(F.col("chunk_ids"), F.array().cast(a.schema["chunk_ids"].dataType)))
        tokens = F.transform(F.regexp_extract_all("answer", F.lit(r"\S+\s*"), F.lit(0)), lambda t: event("token", t))
        every = F.concat(F.array(event("contexts", contexts)), tokens, F.array(event("done", F.col("answer"))))
        return a.select("query_id", F.posexplode(every).alias("n", "e")).select("query_id", "n", "e.type", "e.text")
