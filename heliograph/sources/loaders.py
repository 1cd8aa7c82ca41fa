"""Readers of document collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, kinds: str = "*.{txt,md,rst}") -> DataFrame:
    """doc_id (the file's stem), text, metadata(source, title): one row per file, folders searched through."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=kinds)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select(stem.alias("doc_id"), F.col("value").alias("text"), F.create_map(F.lit("source"), F.col("_metadata.file_path"), F.lit("title"), stem).alias("metadata"))


def documents(rows: DataFrame) -> DataFrame:
    """doc_id, text from rows with id or doc_id; a row without either is an error, a null text is empty."""
    keys = [F.col(c).cast("string") for c in ("id", "doc_id") if c in rows.columns]
    key = F.coalesce(*keys) if keys else F.lit(None).cast("string")
    return rows.select(F.coalesce(key, F.raise_error(F.lit("a document needs an id"))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a BEIR folder; judgements of unknown documents or queries are left out."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    corpus = corpus.select(F.col("_id").alias("doc_id"), F.regexp_replace(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), r"^[. ]+|[. ]+$", "").alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    qrels = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, rel int").csv(f"{path}/qrels/{split}.tsv").filter("rel > 0")
    qrels = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi")
    return corpus, queries.join(qrels.select("query_id"), "query_id", "left_semi"), qrels.select("query_id", "doc_id", "rel")


def multihop(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, gold) of a Parquet file of multi-hop questions with their paragraphs; one row per distinct title."""
    rows = spark.read.parquet(path)
    context = F.explode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")))
    text = F.trim(F.concat(F.col("p.title"), F.lit(". "), F.trim(F.array_join("p.sentences", " "))))
    corpus = rows.select(context.alias("p")).select(F.col("p.title").alias("doc_id"), text.alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    gold = rows.select(F.col("id").alias("query_id"), F.explode("supporting_facts.title").alias("doc_id")).distinct()
    return corpus, rows.select(F.col("id").alias("query_id"), F.col("question").alias("query"), "type"), gold


def labelled_prompts(spark: SparkSession, path: str) -> DataFrame:
    """text, label (1: attack) of a Parquet file (text, label), or of a CSV file (prompt, type)."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return rows.select(F.col("prompt").alias("text"), (F.col("type") == "jailbreak").cast("int").alias("label"))
    return spark.read.parquet(path).select("text", F.col("label").cast("int").alias("label"))


def report(summary: DataFrame, path: str) -> None:
    """An evaluation summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
