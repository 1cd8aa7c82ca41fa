"""Term indexes and lexical retrieval: postings, corpus statistics, BM25, sparse dot products.

Every search takes a DataFrame of queries (query_id, query) and answers all in one plan. Queries of at most LOCAL_QUERIES
rows and LOCAL_CHARS characters in all are sent to where the chunks are (heliograph.operators.local): a task counts its chunks' terms, scores them
against all queries as products of small matrices, and only k rows a query leave each batch. Beyond that size postings
are joined with the queries' terms, and what is shuffled follows these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators import local
from heliograph.session import spread

LOCAL_QUERIES, LOCAL_CHARS = 20_000, 4_000_000
K1, B = 1.5, 0.75
RANK_DECIMALS = 9  # scores are ranked after rounding, so that the order of a sum decides nothing


def top_k(scored: DataFrame, k: int, by: str = "query_id", *ties: Column | str) -> DataFrame:
    """Adds rank within each query and keeps k: by score, then ties (chunk_id if none are given)."""
    order = Window.partitionBy(by).orderBy(F.round("score", RANK_DECIMALS).desc(), *(ties or ("chunk_id",)))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class LexicalIndex:
    """tokens(chunk_id, tokens): the analyzed tokens of every chunk, before stemming; analyzer: simple or english; texts(chunk_id, text)."""

    tokens: DataFrame
    analyzer: str = "english"
    texts: DataFrame | None = None
    _counts: tuple | None = None

    @classmethod
    def build(cls, chunks: DataFrame, analyzer: str = "english", text: str = "text") -> LexicalIndex:
        chunks = spread(chunks.select("chunk_id", F.coalesce(F.col(text), F.lit("")).alias("text")))
        c = F.col("text")
        return cls(chunks.select("chunk_id", (T.content_tokens(c) if analyzer == "english" else T.tokens(c)).alias("tokens")), analyzer, chunks.select("chunk_id", c.alias("text")))

    def terms(self) -> DataFrame:
        """One row (chunk_id, term) per token."""
        t = self.tokens.select("chunk_id", F.explode("tokens").alias("term"))
        return t.withColumn("term", T.stem(F.col("term"))) if self.analyzer == "english" else t

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """chunk_id, term, tf; only: a table of terms to restrict them to."""
        t = self.terms()
        if only is not None:
            t = t.join(only.select("term").distinct(), "term", "left_semi")
        return t.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))

    def lengths(self) -> DataFrame:
        return self.tokens.select("chunk_id", F.size("tokens").alias("dl"))

    def corpus(self) -> DataFrame:
        """One row: n, total tokens, avgdl."""
        return self.lengths().agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("total"), (F.sum("dl") / F.count("*")).alias("avgdl"))

    def term_stats(self, postings: DataFrame | None = None) -> DataFrame:
        """term, df, idf."""
        df = (self.postings() if postings is None else postings).groupBy("term").agg(F.count("*").alias("df"))
        n = self.corpus().select("n")  # one row
        return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") + 0.5 - F.col("df")) / (F.col("df") + 0.5)).alias("idf"))

    def analyze(self, queries: DataFrame) -> DataFrame:
        """query_id, term, qtf: repeated query terms count."""
        q = T.ANALYZERS[self.analyzer](F.col("query"))
        return queries.select("query_id", F.explode(q).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))

    def sent(self, queries: DataFrame):
        """The queries' terms in memory, where they are few enough to go to every task (their size is checked first); else None."""
        if self.texts is None or self.texts.isStreaming or queries.isStreaming:
            return None
        size = queries.agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("c")).first()
        if size.n > LOCAL_QUERIES or (size.c or 0) > LOCAL_CHARS:
            return None
        return local.Asked.of(queries.select("query_id", "query").toArrow(), self.analyzer)

    def counts(self, asked: local.Asked) -> tuple:
        """Corpus statistics for these terms, counted once for one set of terms."""
        terms = frozenset(asked.vocabulary)
        if self._counts is None or self._counts[0] != terms:
            self._counts = terms, local.statistics(self.texts, asked, self.analyzer)
        return self._counts[1]

    def rarest(self, asked: local.Asked, queries: DataFrame) -> DataFrame:
        """query_id, best: the largest idf of a query's terms that are in the corpus."""
        n, _, df = self.counts(asked)
        best = np.full(len(asked.ids), -np.inf)
        met = df[asked.term] > 0
        np.maximum.at(best, asked.query[met], np.log(1 + (n - df + 0.5) / (df + 0.5))[asked.term[met]])
        rows = [(q, float(x)) for q, x in zip(asked.ids.to_pylist(), best) if np.isfinite(x)]
        return queries.sparkSession.createDataFrame(rows, f"query_id {dict(queries.dtypes)['query_id']}, best double")

    def bm25(self, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, keep: DataFrame | None = None, pool: bool = False) -> DataFrame:
        """query_id, chunk_id, rank, score. keep(chunk_id): a filter, applied before the ranking but after the corpus statistics."""
        asked = self.sent(queries)
        if asked is not None:
            return local.bm25(self.texts, asked, self.analyzer, None if pool else k, k1, b, keep, self.counts(asked))
        q = self.analyze(queries)
        postings = self.postings(q)
        stats = self.term_stats(postings)
        if keep is not None:
            postings = postings.join(keep.select("chunk_id"), "chunk_id", "left_semi")
        avg = self.corpus().select(F.greatest(F.col("avgdl"), F.lit(1e-9)).alias("avgdl"))  # one row
        hits = q.join(stats, "term").join(postings, "term").join(self.lengths(), "chunk_id").crossJoin(F.broadcast(avg))
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * weight).alias("score")).filter("score > 0")
        return scored if pool else top_k(scored, k).select("query_id", "chunk_id", "rank", "score")


def sparse_encode(index: LexicalIndex, only: DataFrame | None = None) -> DataFrame:
    """chunk_id, term, weight = ln(1 + tf)."""
    return index.postings(only).select("chunk_id", "term", F.log1p("tf").alias("weight"))


def heaviest(weights: DataFrame, k: int = 96) -> DataFrame:
    """The k heaviest positive terms of each chunk: what a learned encoder keeps."""
    order = Window.partitionBy("chunk_id").orderBy(F.desc("weight"), "term")
    return weights.filter("weight > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def sparse_search(index: LexicalIndex, queries: DataFrame, k: int = 5, keep: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, rank, score: dot products of sparse vectors; positive scores only."""
    asked = index.sent(queries)
    if asked is not None:
        return local.sparse(index.texts, asked, index.analyzer, k, keep)
    q = index.analyze(queries).select("query_id", "term", F.log1p("qtf").alias("qw"))
    docs = sparse_encode(index, q)
    if keep is not None:
        docs = docs.join(keep.select("chunk_id"), "chunk_id", "left_semi")
    scored = q.join(docs, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score")).filter("score > 0")
    return top_k(scored, k).select("query_id", "chunk_id", "rank", "score")


def delete(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The chunks of all other documents."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """new's documents in place of their old chunks."""
    return delete(chunks, new).unionByName(new, allowMissingColumns=True)
