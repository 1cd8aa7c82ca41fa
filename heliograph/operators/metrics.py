"""Ranking and answer metrics: joins of runs with relevance judgements, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """Per query of qrels: ndcg, recall, precision, mrr at k, and average precision at deep; a query missing in the run scores 0.

    run(query_id, doc_id, rank), qrels(query_id, doc_id, rel); relevant means rel > 0.
    """
    good = qrels.filter("rel > 0")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("n_rel"))
    hits = run.join(good, ["query_id", "doc_id"])
    hits = hits.withColumn("found", F.count("*").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("rank") <= k
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(at, F.col("rel") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.countDistinct(F.when(at, F.col("doc_id"))).alias("n_hit"),
        F.sum(at.cast("int")).alias("n_at"),
        F.min(F.when(at, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= deep, F.col("found") / F.col("rank"))).alias("ap"),
    )
    both = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(F.col("n_hit") / F.col("n_rel")).alias("recall"),
        zero(F.col("n_at") / F.lit(k)).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("ap") / F.least(F.col("n_rel"), F.lit(deep))).alias("ap"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"], F.count("*").alias("n_queries"))


def context_metrics(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query of relevant(query_id, doc_id): precision, recall, f1 and ranked precision of the retrieved list (duplicates count)."""
    rel = relevant.distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    got = run.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    got = got.withColumn("so_far", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    per = got.groupBy("query_id").agg(F.avg("hit").alias("p"), F.countDistinct(F.when(F.col("hit") == 1, F.col("doc_id"))).alias("d"), F.count("*").alias("len"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank"))).alias("s"))
    both = n.join(per, "query_id", "left")
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce(F.col("d") / F.col("n_rel"), F.lit(0.0))
    return both.select("query_id", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"), F.coalesce(F.col("s") / F.least("n_rel", "len"), F.lit(0.0)).alias("ranked_precision"))


def faithfulness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, faithfulness: the share of the answer's token set that the contexts hold (1 without tokens)."""
    a = answers.select("query_id", F.explode_outer(F.array_distinct(T.tokens(F.col("answer")))).alias("t"))
    c = contexts.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t")).distinct().withColumn("in", F.lit(1))
    both = a.join(c, ["query_id", "t"], "left")
    return both.groupBy("query_id").agg(F.coalesce(F.sum("in") / F.count("t"), F.when(F.count("t") == 0, 1.0), F.lit(0.0)).alias("faithfulness"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query the share of a's k that b has too."""
    x = a.filter(F.col("rank") <= k).select("query_id", "chunk_id")
    y = b.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return x.join(y, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("overlap"))


def confusion(rows: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, fpr (0 where undefined); 0/1 columns."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    c = rows.agg(*[F.coalesce(F.sum(x.cast("int")), F.lit(0)).cast("long").alias(n) for n, x in (("tp", p & a), ("fp", p & ~a), ("fn", ~p & a), ("tn", ~p & ~a))])
    share = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"))
