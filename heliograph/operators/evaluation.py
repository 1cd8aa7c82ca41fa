"""Evaluation of whole pipelines: per case, in the mean, and small measures around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import vectors as V
from heliograph.operators import dense, metrics

SCORES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_similarity")
MEANS = (*SCORES, "ranked_context_precision", "context_f1", "overall")


def similarity(rows: DataFrame, a: str, b: str, embed=None, dims: int = 128) -> DataFrame:
    """query_id, similarity: the cosine of two text columns' vectors (hashing embeddings unless embed(Column) is given)."""
    if embed is not None:
        return rows.select("query_id", V.cosine(embed(F.col(a)), embed(F.col(b))).alias("similarity"))
    side = lambda c: dense.hashing_vectors(rows.select(F.col("query_id").alias("id"), F.col(c).alias("text")), dims).select(F.col("id").alias("query_id"), F.col("v").alias(f"v_{c}"))
    return side(a).join(side(b), "query_id").select("query_id", V.cosine(F.col(f"v_{a}"), F.col(f"v_{b}")).alias("similarity"))


def overall() -> Column:
    """The mean of the scores that are defined."""
    defined = F.filter(F.array(*[F.col(c) for c in SCORES]), lambda x: x.isNotNull())
    return F.aggregate(defined, F.lit(0.0), lambda s, x: s + x) / F.size(defined)


def evaluate(cases: DataFrame, answers: DataFrame, contexts: DataFrame, embed=None) -> DataFrame:
    """One row per case with all its scores (null where a case has nothing to compare with).

    cases(query_id, query, truth or null), with relevant documents as an array column relevant; answers(query_id, answer);
    contexts(query_id, rank, doc_id, text), the retrieved ones. Retrieved duplicates count.
    """
    relevant = cases.select("query_id", F.explode("relevant").alias("doc_id")).distinct()
    found = metrics.context_metrics(contexts.select("query_id", "doc_id", "rank"), relevant)
    faith = metrics.faithfulness(answers.select("query_id", "answer"), contexts.select("query_id", "text"))
    both = cases.select("query_id", "query", "truth").join(answers.select("query_id", "answer"), "query_id")
    relevancy = similarity(both.select("query_id", "query", "answer"), "query", "answer", embed)
    like = similarity(both.filter("truth is not null").select("query_id", "answer", "truth"), "answer", "truth", embed)
    out = both.join(faith, "query_id", "left").join(relevancy.withColumnRenamed("similarity", "answer_relevancy"), "query_id", "left")
    out = out.join(like.withColumnRenamed("similarity", "answer_similarity"), "query_id", "left").join(found.withColumnsRenamed({"precision": "context_precision", "recall": "context_recall", "f1": "context_f1", "ranked_precision": "ranked_context_precision"}), "query_id", "left")
    return out.withColumn("overall", overall()).drop("truth")


def summary(results: DataFrame) -> DataFrame:
    """One row: the number of cases and the mean of every score over the cases that have it."""
    return results.agg(F.count("*").alias("cases"), *[F.avg(c).alias(c) for c in MEANS])


def markdown(results: DataFrame) -> DataFrame:
    """line of a table of all cases, best first."""
    cells = [F.when(F.col(c).isNull(), F.lit("–")).otherwise(F.format_string("%.3f", F.col(c))) for c in MEANS]
    return results.orderBy(F.desc("overall"), "query_id").select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col("query_id").cast("string"), *cells), F.lit(" |")).alias("line"))


def gold(run: DataFrame, gold_: DataFrame) -> DataFrame:
    """query_id, recall, complete: the share of gold (query_id, doc_id) that the run found, and whether it is all."""
    hit = gold_.distinct().join(run.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"), (F.count("hit") == F.count("*")).alias("complete"))


def document_ranking(run: DataFrame) -> DataFrame:
    """query_id, doc_id, rank: documents in the order of their first chunk. run(query_id, doc_id, rank)."""
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id")).alias("rank"))


def unseen(questions: DataFrame, gold_: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions of whose gold documents the corpus has none: they can't be answered from it."""
    met = gold_.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id").distinct()
    return questions.join(met, "query_id", "left_anti")


def latencies(rows: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row p50, p95, ...: the value at place int(n * share) of the sorted column ms. All are exact."""
    n = F.count("*").over(Window.partitionBy())
    placed = rows.select("ms", F.row_number().over(Window.orderBy("ms")).alias("r"), n.alias("n"))
    return placed.agg(*[F.max(F.when(F.col("r") == F.least(F.floor(F.col("n") * s) + 1, F.col("n")), F.col("ms"))).alias(f"p{round(100 * s)}") for s in shares])


def code_bytes(rows: DataFrame, mode: str = "int8", keep_full: bool = True) -> DataFrame:
    """One row codes, rescoring_store, float32_baseline: bytes that an index of rows(v) takes."""
    each = F.size("v") if mode == "int8" else F.expr("(size(v) + 7) div 8")
    full = F.sum(F.size("v").cast("long") * 4)
    none = F.lit(0).cast("long")
    return rows.agg(F.coalesce(F.sum(each.cast("long")), none).alias("codes"), (F.coalesce(full, none) if keep_full else none).alias("rescoring_store"), F.coalesce(full, none).alias("float32_baseline"))


def spans(events: DataFrame) -> DataFrame:
    """name, n, ms: total duration of traced spans by name. events(name, ms)."""
    return events.groupBy("name").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
