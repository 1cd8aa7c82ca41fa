"""A semantic cache over a log of requests: hits by cosine within a partition, least recently used entries go first.

Requests of a namespace are answered in order, as one sequence (what is in the cache depends on all before); namespaces
are independent and spread over tasks. A task holds at most the entries of one namespace, however long its log is.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = "namespace string, seq long, outcome string, entry long, similarity double, evicted int, expired int"


class Entries:
    """The live entries of a namespace: number of the request that made it, its partition, unit vector and time."""

    def __init__(self, threshold: float, most: int, ttl: float | None):
        self.threshold, self.most, self.ttl = threshold, most, ttl
        self.held: OrderedDict[int, tuple[str, np.ndarray, float]] = OrderedDict()

    def ask(self, seq: int, partition: str, vector: np.ndarray, now: float) -> tuple[str, int | None, float | None, int, int]:
        """outcome, entry, similarity, evicted, expired; a miss is stored."""
        old = [i for i, (_, _, t) in self.held.items() if self.ttl is not None and now - t > self.ttl]
        for i in old:
            del self.held[i]
        norm = float(np.sqrt(vector @ vector))
        unit = vector / norm if norm else vector
        own = [i for i, (p, v, _) in self.held.items() if p == partition and len(v) == len(unit)]
        if own:
            near = np.round(np.array([self.held[i][1] for i in own]) @ unit, 12)
            at = int(near.argmax())  # the first of equals: the least recently used
            if near[at] >= self.threshold:
                self.held.move_to_end(own[at])
                return "hit", own[at], float(near[at]), 0, len(old)
        self.held[seq] = (partition, unit, now)
        evicted = 0
        while len(self.held) > self.most:
            self.held.popitem(last=False)
            evicted += 1
        return "miss", None, None, evicted, len(old)

    def clear(self) -> None:
        self.held.clear()


def replay(requests: DataFrame, threshold: float = 0.92, most: int = 1024, ttl_seconds: float | None = None) -> DataFrame:
    """What the cache does with each request: hit (of which request's entry, how near), miss, bypass, or cleared.

    requests(namespace, seq, partition, v, at seconds, kind): kind "ask"; "bypass" (a filter without a name: neither looked
    up nor stored); "change" (of the corpus: the namespace's entries are dropped).
    """
    if not -1 <= threshold <= 1 or most < 1 or (ttl_seconds is not None and ttl_seconds <= 0):
        raise ValueError("threshold must be within -1..1, most at least 1, ttl_seconds positive or None")
    rows = requests.select(F.col("namespace").cast("string"), F.col("seq").cast("long"), F.col("partition").cast("string"), F.col("v").cast("array<double>"), F.col("at").cast("double"), F.col("kind").cast("string"))

    def run(batches):
        now, entries = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if entries is None or r["namespace"] != now:
                    now, entries = r["namespace"], Entries(threshold, most, ttl_seconds)
                if r["kind"] == "change":
                    entries.clear()
                    got = ("cleared", None, None, 0, 0)
                elif r["kind"] == "bypass":
                    got = ("bypass", None, None, 0, 0)
                else:
                    got = entries.ask(r["seq"], r["partition"], np.array(r["v"] or [], np.float64), r["at"] or 0.0)
                out.append((r["namespace"], r["seq"], *got))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in OUTCOMES.split(", ")])

    return rows.repartition("namespace").sortWithinPartitions("namespace", "seq").mapInArrow(run, OUTCOMES)


def stats(outcomes: DataFrame) -> DataFrame:
    """namespace, hits, misses, evictions, expirations, bypasses, hit_rate."""
    n = lambda x: F.sum((F.col("outcome") == x).cast("long"))
    hits, misses = n("hit"), n("miss")
    rate = F.when(hits + misses > 0, F.round(hits / (hits + misses), 4)).otherwise(F.lit(0.0))
    return outcomes.groupBy("namespace").agg(hits.alias("hits"), misses.alias("misses"), F.sum("evicted").alias("evictions"), F.sum("expired").alias("expirations"), n("bypass").alias("bypasses"), rate.alias("hit_rate"))


def answered(pipeline, queries: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """The answers of all asked queries: a pipeline answers only those that missed, hits get the answer of their entry.

    queries(query_id, query) with query_id the seq of the one namespace in outcomes. Adds cache (hit or miss) and cached_query_id.
    """
    asked = outcomes.filter("outcome in ('hit', 'miss', 'bypass')").select(F.col("seq").alias("query_id"), "outcome", F.coalesce("entry", "seq").alias("from_id"))
    fresh = queries.join(asked.filter("outcome <> 'hit'"), "query_id", "left_semi")
    made = pipeline.answer(fresh, **options).drop("query").withColumnRenamed("query_id", "from_id")
    out = queries.join(asked, "query_id").join(made, "from_id")
    return out.withColumn("cache", F.col("outcome")).withColumn("cached_query_id", F.when(F.col("outcome") == "hit", F.col("from_id"))).drop("outcome", "from_id")
