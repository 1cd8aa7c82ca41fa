"""Toxicity by a character n-gram linear classifier with naive Bayes feature scaling, trained on labelled text.

Features are the distinct character n-grams of a text (hashed, lower-cased, over word bounds). Each is scaled by its
naive Bayes log-count ratio r = ln((p + 1) / |p|) / ((q + 1) / |q|) of toxic against other texts; a logistic
regression with an L2 penalty is fitted on the scaled features.

Training reads at most SAMPLE labelled documents, in an order of hashes of doc_id, as whole texts of any length. Their
n-grams are counted where the rows are (a fixed number of counters for each task, summed by ranges of buckets); the
model keeps the FEATURES n-grams of most evidence, and the driver gets only which of these each sampled row has.
Scoring reads whole texts of all rows; the model that travels is a fixed number of weights.

Defined cases: null and empty texts are scored like texts without features (the intercept). Without labelled rows of
both classes every score is the smoothed share of toxic rows. Null labels are ignored; of several labels of one
doc_id the largest counts, and of several rows of a labelled doc_id one is learned from. doc_id null: scored, never
trained on (held_out is false).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import chargrams as G
from heliograph.llm import common as C

NS = (5, 6, 7)
FEATURES = 4_096
SAMPLE = 12_000
RANGES = 48  # of buckets, in counting
TASKS = 12  # that count the sample
L2 = 1.0
STEPS = 250


class Model:
    """The chosen buckets, the weight of each, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept
        self._table = None

    def __getstate__(self):
        return self.buckets, self.weights, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.full(len(NS) << G.BITS, -1, np.int32)
            self._table[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return self._table

    def scores(self, column) -> np.ndarray:
        total = np.full(len(column), self.intercept)
        if len(self.buckets) and len(column):
            doc, feature = G.present(column, NS, self.table)
            total += np.bincount(doc, self.weights[feature], len(column))
        return 1 / (1 + np.exp(-total))


def _gain(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Evidence: the log-likelihood gain of telling the classes apart by an n-gram that so many of either class hold."""
    p, q, both = (toxic + 1) / (n1 + 2), (other + 1) / (n0 + 2), (toxic + other + 2) / (n1 + n0 + 4)
    return toxic * np.log(p / both) + other * np.log(q / both) + (n1 - toxic) * np.log((1 - p) / (1 - both)) + (n0 - other) * np.log((1 - q) / (1 - both))


def _counted(batches):
    """Of the rows (text, toxic) of one task: for each range of buckets, how many toxic and how many other texts hold each."""
    size = len(NS) << G.BITS
    counts = np.zeros((2, size), np.int32)
    for whole in batches:
        for b in C.chunks(whole):
            for kind, f in zip(b.column(1).to_pylist(), G.distinct(b.column(0), NS)):
                counts[kind][f] += 1
    each = size // RANGES
    rows = [(r, counts[:, r * each : (r + 1) * each].tobytes()) for r in range(RANGES) if counts[:, r * each : (r + 1) * each].any()]
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "counts"])
    C.trim()


def _evidence(n1: int, n0: int, features: int):
    """Of one range of buckets: its n-grams of most evidence, and (as bucket -1) the sums of all counts."""
    each = (len(NS) << G.BITS) // RANGES

    def run(key, table):
        other, toxic = sum(np.frombuffer(x.as_py(), np.int32).reshape(2, each) for x in table["counts"])
        at = np.flatnonzero(toxic + other)
        gain = _gain(toxic[at].astype(float), other[at].astype(float), n1, n0)
        best = np.argsort(-gain, kind="stable")[:features]
        best = best[gain[best] > 0]
        bucket = np.r_[at[best] + key[0].as_py() * each, -1]
        sums = ((toxic[at], toxic), (other[at], other))
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "gain": pa.array(np.r_[gain[best], np.inf]), **{n: pa.array(np.r_[x[best], y.sum(dtype=np.int64)], pa.int64()) for n, (x, y) in zip(("toxic", "other"), sums)}})

    return run


def solve(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (of the unscaled features) and intercept of the logistic regression; rows: the features that each text has."""
    y = np.asarray(labels, np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    feature = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    sizes = np.array([len(x) for x in rows], np.int64)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(feature, kind="stable")
    by_doc = doc[order]
    bounds = np.searchsorted(feature[order], np.arange(len(r) + 1))
    filled = np.flatnonzero(np.diff(bounds))
    w, b = np.zeros(len(r)), float(np.log(n1 / n0))
    weight = np.where(y == 1, n0 / n1, 1.0) ** 0.5
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    held = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[held]
    for step in range(1, STEPS + 1):  # Adam on the full sample
        z = np.full(len(y), b)
        if len(feature):
            z[held] += np.add.reduceat((r * w)[feature], starts)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        gw = L2 * w
        if len(filled):
            gw[filled] += np.add.reduceat(g[by_doc], bounds[filled]) * r[filled]
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.02 * (1 - step / (STEPS + 1))
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * 5 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * r, float(b)


def constant(share: float) -> Model:
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))


def train(sample: DataFrame, features: int = FEATURES) -> Model:
    """From rows (key, text, toxic) of a stored sample."""
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return constant((n1 + 0.5) / (n1 + n0 + 2))
    counts = sample.select("text", "toxic").mapInArrow(_counted, "range int, counts binary")
    found = counts.groupBy("range").applyInArrow(_evidence(n1, n0, features), "bucket long, gain double, toxic long, other long")
    found = C.cut(found)
    sums = found.filter("bucket < 0").agg(F.sum("toxic"), F.sum("other")).first()
    best = found.filter("bucket >= 0").orderBy(F.desc("gain"), "bucket").limit(features).toArrow()
    at = np.argsort(best["bucket"].to_numpy())
    chosen, toxic, other = (best[c].to_numpy()[at].astype(np.int64) for c in ("bucket", "toxic", "other"))
    size = len(NS) << G.BITS
    r = np.log(((toxic + 1) / (sums[0] + size)) / ((other + 1) / (sums[1] + size)))
    place = Model(chosen, np.zeros(len(chosen)), 0.0)

    def held(batches):
        for whole in batches:
            for b in C.chunks(whole):
                d, f = G.present(b.column(1), NS, place.table)
                cuts = np.searchsorted(d, np.arange(b.num_rows + 1))
                own = [f[i:j].astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.binary())], ["key", "toxic", "features"])

    got = sample.select("key", "text", "toxic").mapInArrow(held, "key long, toxic int, features binary").toArrow().sort_by([("key", "ascending"), ("features", "ascending")])
    w, b = solve([np.frombuffer(x.as_py(), np.int32) for x in got["features"]], got["toxic"].to_numpy(), r)
    return Model(chosen, w, b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 5, features: int = FEATURES) -> Model:
    """Trains on labelled rows of docs whose crc32(doc_id) modulo held_out isn't 0 (held_out 0: all)."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string")) % held_out != 0)
    known = C.bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), F.lit(True), sample)
    found = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(known), "doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    found = found.repartition(TASKS, "doc_id").withColumn("n", F.row_number().over(one)).filter("n = 1").select(F.col("doc_id").alias("key"), "text", "toxic")
    return train(C.written(found, "labelled"), features)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows and columns of docs that score below the threshold."""
    names = docs.columns

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole, column="text"):
                yield b.filter(pa.array(model.scores(pc.cast(b.column(names.index("text")), pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
