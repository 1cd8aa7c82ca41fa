"""Attribution of answer sentences to context sentences, and extractive answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions import vectors as V

NO_ANSWER = "I don't have enough " + "information to answer that."


def _pieces(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per sentence: key, s (its number), start, end, sentence."""
    found = rows.select(*key, F.posexplode(T.sentences(F.coalesce(F.col(text), F.lit("")))).alias("s", "p"))
    return found.select(*key, "s", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.match").alias("sentence"))


def attribute(
    answers: DataFrame, contexts: DataFrame, threshold: float = 0.6, most: int = 2, embed: Callable[[Column], Column] | None = None, semantic_weight: float = 0.5, entails: Callable[[Column, Column], Column] | None = None, entailment_weight: float = 0.8, candidates: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(sentences, citations) of answers(answer_id, answer) against contexts(answer_id, marker, chunk_id, text, start_char).

    A context's support of a sentence is the largest share of the sentence's content tokens that one of its sentences
    holds. Sentences: answer_id, s, sentence, start, end, support, supported, claimed, invalid. Citations: answer_id, s,
    marker, chunk_id, start_char, end_char, quote, score. Tokens are joined, so only sentences that share one meet.

    embed (text to vector) blends the cosine of the best sentence into its score. entails (premise, hypothesis to a
    probability) is asked about the `candidates` sentences of each context that share most, even if they share nothing.
    """
    if not (0 <= threshold <= 1 and 0 <= semantic_weight <= 1 and 0 <= entailment_weight <= 1 and most >= 1 and candidates >= 1):
        raise ValueError("threshold and weights must be within 0..1, most and candidates at least 1")
    a = _pieces(answers, ["answer_id"], "answer")
    words = lambda c: F.array_distinct(T.content_tokens(c, T.CITATION_STOPWORDS))
    a = a.withColumn("words", words(F.regexp_replace("sentence", r"\[\d{1,3}\]", " "))).withColumn("claimed", F.transform(F.regexp_extract_all("sentence", F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    c = _pieces(contexts, ["answer_id", "marker", "chunk_id", "start_char"], "text").withColumnsRenamed({"s": "cs", "start": "a", "end": "b", "sentence": "quote"})
    ct = c.select("answer_id", "marker", "cs", F.explode(words(F.col("quote"))).alias("t"))
    at = a.select("answer_id", "s", F.size("words").alias("n"), F.explode("words").alias("t"))
    met = at.join(ct, ["answer_id", "t"]).groupBy("answer_id", "s", "n", "marker", "cs").agg(F.count("*").alias("x"))
    first = Window.partitionBy("answer_id", "s", "marker").orderBy(F.desc("x"), "cs")
    best = met.withColumn("r", F.row_number().over(first)).filter("r = 1").select("answer_id", "s", "marker", "cs", (F.col("x") / F.col("n")).alias("score"))
    if entails is not None or embed is not None:
        clean = F.trim(F.regexp_replace("sentence", r"\[\d{1,3}\]", " "))
        said = a.filter("size(words) > 0").select("answer_id", "s", clean.alias("clean"), F.size("words").alias("n"))
        quotes = c.select("answer_id", "marker", "cs", "quote")
        if entails is not None:  # an answer's sentences with those of its own few contexts
            met = said.select("answer_id", "s", "n").join(quotes.drop("quote"), "answer_id").join(met.drop("n"), ["answer_id", "s", "marker", "cs"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
        near = met.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= (candidates if entails is not None else 1))
        near = near.join(said.drop("n"), ["answer_id", "s"]).join(quotes, ["answer_id", "marker", "cs"])
        share = F.col("x") / F.col("n")
        if entails is not None:
            score = (1 - entailment_weight) * share + entailment_weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), entails(F.col("quote"), F.col("clean"))))
        else:
            score = (1 - semantic_weight) * share + semantic_weight * F.greatest(F.lit(0.0), V.cosine(embed(F.col("clean")), embed(F.col("quote"))))
        near = near.select("answer_id", "s", "marker", "cs", "r", score.alias("score"))
        top = Window.partitionBy("answer_id", "s", "marker").orderBy(F.round("score", 12).desc(), "r")
        best = near.withColumn("t", F.row_number().over(top)).filter("t = 1").select("answer_id", "s", "marker", "cs", "score")
    support = best.groupBy("answer_id", "s").agg(F.max("score").alias("support"), F.collect_set(F.when(F.col("score") >= threshold, F.col("marker"))).alias("good"))
    out = a.join(support, ["answer_id", "s"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    invalid = F.array_except("claimed", F.coalesce("good", F.array().cast("array<int>")))
    sentences = out.select("answer_id", "s", "sentence", "start", "end", "support", ((F.col("support") >= threshold) & (F.size("words") > 0)).alias("supported"), "claimed", invalid.alias("invalid"))
    order = Window.partitionBy("answer_id", "s").orderBy(F.round("score", 9).desc(), "marker")
    cited = best.filter(F.col("score") >= threshold).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    cited = cited.join(c, ["answer_id", "marker", "cs"])
    return sentences, cited.select("answer_id", "s", "marker", "chunk_id", (F.col("start_char") + F.col("a")).alias("start_char"), (F.col("start_char") + F.col("b")).alias("end_char"), "quote", "score")


def groundedness(answers: DataFrame, sentences: DataFrame) -> DataFrame:
    """answer_id, groundedness: the share of supported sentences, 0 without sentences."""
    per = sentences.groupBy("answer_id").agg(F.avg(F.col("supported").cast("int")).alias("g"))
    return answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", F.coalesce("g", F.lit(0.0)).alias("groundedness"))


def markdown(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, markdown: sentences without claimed markers, then their citations, or a note that there are none."""
    c = citations.groupBy("answer_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_set("marker")), lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), "").alias("marks"))
    clean = F.trim(F.regexp_replace("sentence", r"\s*\[\d{1,3}\]", ""))
    rows = sentences.join(c, ["answer_id", "s"], "left").select("answer_id", "s", F.concat_ws(" ", clean, F.coalesce("marks", F.lit("(unverified)"))).alias("line"))
    return rows.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "line"))), lambda x: x["line"]), " ").alias("markdown"))


def extractive(queries: DataFrame, contexts: DataFrame, most: int = 2, min_score: float = 0.0) -> DataFrame:
    """query_id, answer: the context sentences that cover most of the query's idf weight, in reading order.

    contexts(query_id, rank, text). A sentence must cover more than min_score; without one the answer is a refusal.
    """
    s = _pieces(contexts, ["query_id", "rank"], "text")
    n = s.groupBy("query_id").agg(F.count("*").alias("n"))
    q = queries.select("query_id", F.explode(F.array_distinct(T.english(F.col("query")))).alias("term"))
    t = s.select("query_id", "rank", "s", F.explode(F.array_distinct(T.english(F.col("sentence")))).alias("term")).join(q, ["query_id", "term"])
    df = t.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    idf = q.join(n, "query_id").join(df, ["query_id", "term"], "left").select("query_id", "term", F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))
    total = idf.groupBy("query_id").agg(F.sum("idf").alias("total"))
    cover = t.join(idf, ["query_id", "term"]).groupBy("query_id", "rank", "s").agg(F.sum("idf").alias("x")).join(total, "query_id")
    cover = cover.withColumn("score", F.round(F.col("x") / F.col("total"), 9)).filter(F.col("score") > min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "s")
    best = cover.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("query_id", "rank", "s")
    text = best.join(s, ["query_id", "rank", "s"]).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s", "sentence"))), lambda x: x["sentence"]), " ").alias("answer"))
    return queries.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"))
