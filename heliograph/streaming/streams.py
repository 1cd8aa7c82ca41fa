"""Structured Streaming: incremental term indexes, event windows, expiring caches, answer tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators.lexical import LexicalIndex
from heliograph.sources.store import Store


def ingest(documents: DataFrame, store: Store, checkpoint: str, analyzer: str = "english", chunk=None) -> StreamingQuery:
    """A stream of documents into the store's chunks; a batch that is replayed after a failure is written once."""

    def batch(df: DataFrame, epoch: int) -> None:
        if store.manifest["config"].get("epoch", -1) >= epoch:
            return
        rows = chunk(df) if chunk else df.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"), "doc_id", "text")
        store.ingest(rows, {"epoch": epoch})  # one commit: a batch that fails isn't marked as done

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(documents: DataFrame, analyzer: str = "english") -> DataFrame:
    """Running counts (chunk_id, term, tf) of a stream (or table) of chunks."""
    return LexicalIndex.build(documents, analyzer).postings()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs time zones; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) counts and sums by event type: start, event_type, n, total."""
    e = _timed(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: user_id, start, end, n."""
    e = _timed(events, late)
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_entries(entries: DataFrame, now: Column, ttl_seconds: float | None) -> DataFrame:
    """Cache entries that haven't expired (age over the time to live)."""
    if ttl_seconds is None:
        return entries
    return entries.filter(now.cast("double") - F.col("created_at").cast("double") <= ttl_seconds)


def fresh_queries(queries: DataFrame, ttl: str) -> DataFrame:
    """A stream of queries without repeats within the time to live."""
    return _timed(queries, ttl).dropDuplicatesWithinWatermark(["query"])


def answer_tokens(answers: DataFrame) -> DataFrame:
    """answer_id, n, token: an answer as the events that a client receives."""
    return answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\S+\s*"), F.lit(0))).alias("n", "token"))


