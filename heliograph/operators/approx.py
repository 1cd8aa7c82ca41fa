"""Approximate vector search: inverted lists around centroids, with a dial from fast to exact.

Rows are put to the nearest of some centroids (spherical k-means over a bounded sample) and stored by list; a query looks
through the `probes` lists nearest to it. With all lists probed the result is exact. Filters apply before the ranking;
where a filtered search finds fewer than k rows, the query is answered by the exact scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators import dense
from heliograph.operators.lexical import top_k
from heliograph.session import shared_folder

SAMPLE = 20_000
ROUNDS = 12


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: the sample's directions around so many centres."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


@dataclass
class Lists:
    """centres: one unit vector for each list; table(list, id, v, ...): unit vectors, stored by list."""

    centres: np.ndarray
    table: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Lists:
        """From rows(id, v, and columns for filters); as many lists as the root of the number of rows, if not said."""
        spark = rows.sparkSession
        n = rows.count()
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).toArrow().combine_chunks()
        if not some.num_rows:
            return cls(np.zeros((0, 0)), rows.select(F.lit(0).alias("list"), *rows.columns))
        _, unit = dense._vectors(some["id"].combine_chunks(), some["v"].combine_chunks(), "cosine")
        centres = centroids(unit, lists or max(1, round(math.sqrt(n))), seed)
        place = f"{shared_folder(spark)}/lists-{id(centres):x}-{seed}-{n}"
        rows.withColumn("list", _nearest(F.col("v"), centres, 1)[0]).write.mode("overwrite").partitionBy("list").parquet(place)
        return cls(centres, spark.read.parquet(place))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, keep: Column | None = None, exclude_self: bool = True) -> DataFrame:
        """query_id, chunk_id, rank, score by cosine; probes: lists that each query looks through."""
        sent = (queries.agg(F.sum(F.size("v"))).first()[0] or 0) * probes
        if not len(self.centres) or sent > dense.SENT_CELLS:  # too many queries to send: blocks of all rows, exactly
            return dense.block_search(queries, (self.table if keep is None else self.table.filter(keep)).select("id", "v"), k, exclude_self=exclude_self)
        rows = self.table if keep is None else self.table.filter(keep)
        wide = queries.select("id", "v", F.explode(_nearest(F.col("v"), self.centres, min(probes, len(self.centres)))).alias("list"))
        found = _within(wide, rows, k, exclude_self)
        found = top_k(found, k).select("query_id", "chunk_id", "rank", "score")
        if keep is None:
            return found
        got = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        poor = queries.join(got.select(F.col("query_id").alias("id")), "id", "left_anti")
        exact = dense.block_search(poor, rows.select("id", "v"), k, exclude_self=exclude_self)
        return found.join(got, "query_id", "left_semi").unionByName(exact)


def _nearest(v: Column, centres: np.ndarray, most: int) -> Column:
    """The numbers of the nearest centres, nearest first."""
    def run(s: pd.Series) -> pd.Series:
        m = np.array(s.tolist(), np.float64).reshape(len(s), -1)
        near = np.argsort(-np.round(m @ centres.T, 12), axis=1, kind="stable")[:, :most]
        return pd.Series(near.astype(np.int32).tolist())

    return F.pandas_udf(run, "array<int>")(v)


def _within(wide: DataFrame, rows: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k best of each query in each batch of a list that it probes; queries go to where the rows are."""
    asked = wide.select(F.col("id").cast("long"), "list", F.col("v").cast("array<double>")).toArrow().combine_chunks()
    if asked.num_rows:
        qi, q = dense._vectors(asked["id"].combine_chunks(), asked["v"].combine_chunks(), "cosine")
        of = asked["list"].to_numpy()
    else:
        qi, q, of = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64)
    probed = sorted(set(of.tolist()))

    def run(batches):
        for b in batches:
            lists = b.column(0).to_numpy()
            for x in np.unique(lists):
                at, mine = np.flatnonzero(lists == x), np.flatnonzero(of == x)
                if len(mine):
                    part = b.take(at)
                    yield dense._tile(qi[mine], q[mine], *dense._vectors(part.column(1), part.column(2), "cosine"), k, "cosine", exclude_self, None)

    # Only the folders of probed lists are read.
    return rows.filter(F.col("list").isin(probed)).select(F.col("list").cast("int"), F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, dense.FOUND)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row recall: the share of the exact results that were found."""
    hit = exact.filter(F.col("rank") <= k).select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
