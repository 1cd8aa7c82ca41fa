"""Bounded retrieve, grade and rewrite loop over all open questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.operators import graph
from heliograph.operators.fusion import interleave

ABSTAIN = "I don't have enough information " + "in the knowledge base to answer that."


def _keys(text: Column) -> Column:
    return F.transform(T.content_tokens(text), T.suffix_key)


def grade(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, score, missing: how much of a question's content terms its contexts hold. contexts(query_id, text)."""
    q = questions.select("query_id", F.explode_outer(T.content_tokens(F.col("query"))).alias("term")).withColumn("k", T.suffix_key(F.col("term")))
    q = q.groupBy("query_id", "k").agg(F.max("term").alias("term"))
    c = contexts.select("query_id", F.explode(_keys(F.col("text"))).alias("k")).distinct().withColumn("in", F.lit(1))
    both = q.join(c, ["query_id", "k"], "left")
    lost = F.array_sort(F.collect_set(F.when(F.col("in").isNull(), F.col("term"))))
    return both.groupBy("query_id").agg(F.when(F.count("k") == 0, 1.0).otherwise(F.count("in") / F.count("k")).alias("score"), lost.alias("missing"))


def relax(query: Column, missing: Column) -> Column:
    """The question without words that no context holds; empty if nothing searchable is left."""
    words = F.filter(F.split(query, "(?U)\\s+"), lambda w: (w != "") & ~F.array_contains(missing, F.lower(F.regexp_replace(w, "(?U)\\W", ""))))
    text = F.array_join(words, " ")
    return F.when(F.size(T.content_tokens(text)) > 0, text).otherwise("")


def bridge(questions: DataFrame, contexts: DataFrame, most: int = 3, top: int = 2) -> DataFrame:
    """query_id, new: the question with the first new entities of its best contexts. contexts(query_id, rank, text)."""
    q = questions.select("query_id", "query")
    own = graph.mentions(q.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))).select(F.col("chunk_id").alias("query_id"), "entity")
    c = contexts.filter(F.col("rank") <= top).select(F.struct("query_id", "rank").alias("chunk_id"), "text")
    found = graph.mentions(c).select("chunk_id.query_id", "chunk_id.rank", "entity", "display", F.monotonically_increasing_id().alias("ord"))
    fresh = found.join(own, ["query_id", "entity"], "left_anti").join(q, "query_id").filter(~F.contains(F.lower("query"), F.col("entity")))
    first = fresh.groupBy("query_id", "entity").agg(F.min(F.struct("rank", "ord", "display")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.rank", "f.ord")
    kept = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    add = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "f.display"))), lambda x: x["display"]), " ").alias("more"))
    return q.join(add, "query_id").select("query_id", F.concat_ws(" ", "query", "more").alias("new"))


def run(questions: DataFrame, retrieve: Callable[[DataFrame, DataFrame | None], DataFrame], chunks: DataFrame, k: int = 5, most: int = 3, least: int = 1, sufficient: float = 0.7, abstain: float = 0.3, decompose: bool = False, rewrite: str = "relax", cut: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> tuple[DataFrame, DataFrame]:
    """(results, contexts): at most so many rounds, each one plan for all sub-questions that are still open.

    retrieve(queries, seen) answers (query_id, query) with (query_id, chunk_id, rank, score); seen holds pairs that later
    hops mustn't return (with least > 1). results: question_id, sufficiency, abstained, retrievals. contexts: question_id,
    chunk_id, place.
    """
    parts = T.split_question(F.col("query")) if decompose else F.array("query")
    subs = questions.select(F.col("query_id").alias("question_id"), F.posexplode(parts).alias("group_no", "sub"))
    subs = subs.withColumn("query_id", F.concat_ws("/", F.col("question_id").cast("string"), F.col("group_no").cast("string")))
    live = cut(subs.select("query_id", "question_id", "group_no", "sub", F.col("sub").alias("query"), F.array("sub").alias("tried"), F.lit(0.0).alias("best")))
    pool, done = None, None
    for attempt in range(1, most + 1):
        seen = pool.select("query_id", "chunk_id") if pool is not None and least > 1 else None
        found = retrieve(live.select("query_id", "query"), seen).select("query_id", "chunk_id", "score")
        every = found if pool is None else found.unionByName(pool)
        pool = cut(every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")))
        ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))).filter(F.col("rank") <= max(k, 1))
        texts = ranked.join(chunks.select("chunk_id", "text"), "chunk_id")
        g = grade(live.select("query_id", F.col("sub").alias("query")), texts)
        state = live.join(g, "query_id").withColumn("best", F.greatest("best", "score"))
        if rewrite == "bridge":
            new = bridge(live.select("query_id", F.col("sub").alias("query")), texts)
            state = state.join(new, "query_id", "left").withColumn("new", F.coalesce("new", F.lit("")))
        else:
            state = state.withColumn("new", relax(F.col("sub"), F.col("missing")))
        ends = (F.col("score") >= sufficient) & F.lit(attempt >= least) | (F.col("new") == "") | F.array_contains("tried", F.col("new")) | F.lit(attempt == most)
        state = cut(state.withColumn("ends", ends).withColumn("tries", F.lit(attempt)))
        ended = state.filter("ends").select("query_id", "question_id", "group_no", "best", "tries")
        done = ended if done is None else done.unionByName(ended)
        live = state.filter("not ends").select("query_id", "question_id", "group_no", "sub", F.col("new").alias("query"), F.array_append("tried", F.col("new")).alias("tried"), "best")
        if not live.limit(1).count():
            break
    per = done.groupBy("question_id").agg(F.avg("best").alias("sufficiency"), F.sum("tries").alias("retrievals"), F.max("tries").alias("tries"), F.count("*").alias("subs"))
    ranked = pool.join(done.select("query_id", "question_id", "group_no"), "query_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")))
    budget = F.greatest(F.lit(k) * F.col("tries") if least > 1 else F.lit(k), F.col("subs"))
    limits = per.select("question_id", budget.alias("budget"))
    contexts = interleave(ranked, 1 << 30).join(limits, "question_id").filter("place <= budget").select("question_id", "chunk_id", "place")
    some = contexts.select("question_id").distinct().withColumn("some", F.lit(True))
    results = per.join(some, "question_id", "left").select("question_id", "sufficiency", ((F.col("sufficiency") < abstain) | F.col("some").isNull()).alias("abstained"), "retrievals")
    return results, contexts
