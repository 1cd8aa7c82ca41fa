"""Models as functions: each takes lists and is called with pieces of Arrow batches, where the rows are."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions.batches import piecewise
from heliograph.operators import agent
from heliograph.operators.citations import NO_ANSWER
from heliograph.operators.lexical import heaviest

Complete = Callable[[list[str]], list[str]]


def _batch(fn, kind: str):
    """A pandas UDF of a function of lists."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(fn(*[list(c) for c in columns])), dtype=object)

    if kind == "double":
        return piecewise(lambda *c: run(*c).astype(float), kind)
    return piecewise(run, kind)


def embed(text: Column, fn: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors of an embedding model."""
    return _batch(lambda t: [[float(x) for x in v] for v in fn(t)], "array<double>")(F.coalesce(text, F.lit("")))


def sparse_encode(chunks: DataFrame, fn: Callable[[list[str]], list[dict[str, float]]], most: int = 96) -> DataFrame:
    """chunk_id, term, weight: the heaviest positive terms that a sparse encoder gives each chunk."""
    weights = chunks.select("chunk_id", F.explode(_batch(fn, "map<string,double>")(F.coalesce("text", F.lit("")))).alias("term", "weight"))
    return heaviest(weights, most)


def sparse_search(encoded: DataFrame, queries: DataFrame, fn: Callable[[list[str]], list[dict[str, float]]], k: int = 5) -> DataFrame:
    """query_id, chunk_id, rank, score: dot products of encoded queries and chunks."""
    from heliograph.operators.lexical import top_k

    q = sparse_encode(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), fn).select(F.col("chunk_id").alias("query_id"), "term", F.col("weight").alias("w"))
    scored = q.join(encoded, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score")).filter("score > 0")
    return top_k(scored, k).select("query_id", "chunk_id", "rank", "score")


def entailment(premise: Column, hypothesis: Column, fn: Callable[[list[str], list[str]], list[float]]) -> Column:
    """The probability that the premise entails the hypothesis, within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _batch(fn, "double")(premise, hypothesis)))


def generate(query: Column, contexts: Column, fn: Callable[[list[str], list[list[str]]], list[str]] | None = None) -> Column:
    """A generator's answer from a question and its contexts; without a generator the first context, or a refusal."""
    if fn is None:
        return F.coalesce(F.get(contexts, F.lit(0)), F.lit(NO_ANSWER))
    return _batch(lambda q, c: fn(q, [list(x) for x in c]), "string")(query, contexts)


def complete(prompt: Column, fn: Complete) -> Column:
    return F.trim(_batch(fn, "string")(prompt))


def paraphrases(queries: DataFrame, fn: Complete, n: int = 3) -> DataFrame:
    """query_id, lines: a model's rewordings of each query, cleaned of list marks, for fusion.expand."""
    ask = F.concat(F.lit(f"Give {n} other wordings of this search query with the same meaning, one on each line and nothing else.\n\n"), F.col("query"))
    lines = F.filter(F.transform(F.split(complete(ask, fn), "\n"), lambda x: F.trim(T.clean_variant(F.trim(x)))), lambda x: x != "")
    return queries.select("query_id", F.slice(lines, 1, n).alias("lines"))


def hypothetical(queries: DataFrame, fn: Complete, keywords: bool = False) -> DataFrame:
    """query_id, lines: a made-up passage that would answer each query (and its search terms), to search with besides the query."""
    passage = complete(F.concat(F.lit("Write a few sentences of a reference work that would answer this question.\n\n"), F.col("query")), fn)
    lines = [F.regexp_replace(passage, "\\s+", " ")]
    if keywords:
        lines.append(complete(F.concat(F.lit("Name the search terms of this question, with spaces between them.\n\n"), F.col("query")), fn))
    return queries.select("query_id", F.filter(F.array(*lines), lambda x: x != "").alias("lines"))


def situated(document: Column, chunk: Column, fn: Complete, most: int = 12_000) -> Column:
    """A model's sentence on where a chunk stands in its document, of which it sees the first `most` characters."""
    parts = [F.lit("<document>\n"), F.substring(document, 1, most), F.lit("\n</document>\n<chunk>\n"), chunk, F.lit("\n</chunk>\nSay in one sentence where this chunk stands in the document. Reply with that sentence alone.")]
    return complete(F.concat(*parts), fn)


def _json(raw: str | None, pattern: str):
    found = re.search(pattern, raw or "", re.S)
    try:
        return json.loads(found.group()) if found else None
    except ValueError:
        return None


def graded(questions: DataFrame, contexts: DataFrame, fn: Complete) -> DataFrame:
    """query_id, score, missing by a model; where its reply can't be read, the lexical grade."""
    texts = contexts.groupBy("query_id").agg(F.array_join(F.collect_list("text"), "\n\n").alias("texts"))
    ask = F.concat(F.lit('Do the contexts answer the question? Reply with JSON: {"score": 0 to 1, "missing": [what is still needed]}\n\n<question>\n'), F.col("query"), F.lit("\n</question>\n<contexts>\n"), F.coalesce("texts", F.lit("")), F.lit("\n</contexts>"))

    def read(replies: list[str]) -> list[str | None]:
        out = []
        for data in (_json(r, r"\{.*\}") for r in replies):
            try:
                out.append(json.dumps({"score": max(0.0, min(1.0, float(data["score"]))), "missing": [str(x) for x in data.get("missing") or []]}))
            except (KeyError, TypeError, ValueError, AttributeError):
                out.append(None)
        return out

    by_model = questions.join(texts, "query_id", "left").select("query_id", F.from_json(_batch(read, "string")(complete(ask, fn)), "score double, missing array<string>").alias("m"))
    both = agent.grade(questions, contexts).join(by_model, "query_id")
    return both.select("query_id", F.coalesce("m.score", "score").alias("score"), F.when(F.col("m.score").isNotNull(), F.col("m.missing")).otherwise(F.col("missing")).alias("missing"))


def rewritten(question: Column, missing: Column, tried: Column, fn: Complete) -> Column:
    """A model's next query: the first line of its reply, without quotes; empty if it has none."""
    ask = F.concat(F.lit("Write another search query that finds what is missing. Reply with the query alone.\n\nQuestion: "), question, F.lit("\nMissing: "), F.array_join(missing, ", "), F.lit("\nTried: "), F.array_join(tried, "; "))
    line = F.coalesce(F.get(F.split(complete(ask, fn), "\n"), F.lit(0)), F.lit(""))
    return F.trim(F.regexp_replace(F.trim(line), "^[\"']+|[\"']+$", ""))


def decomposed(question: Column, fn: Complete, most: int = 4) -> Column:
    """A model's sub-questions, or the question itself where its reply isn't a list."""
    ask = F.concat(F.lit(f"Split this question into at most {most} that can be answered apart. Reply with a JSON list of strings.\n\n"), question)

    def read(replies: list[str]) -> list[list[str]]:
        lists = (_json(r, r"\[.*\]") for r in replies)
        return [[str(p).strip() for p in x if str(p).strip()][:most] if isinstance(x, list) else [] for x in lists]

    parts = _batch(read, "array<string>")(complete(ask, fn))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(question))
