"""Language identification in two steps: first the family, then one-versus-one linear SVMs within it.

A text is the relative frequencies of its hashed character n-grams (lower-cased, over word bounds). Linear support
vector machines (squared hinge, L2 penalty) are trained one versus the rest for families, and one versus one for
every two languages of a family. A prediction takes the family of the largest margin; within it the language that
wins most duels, ties to the larger sum of margins, then to the smaller name. Languages of no known family are
families of their own.

Training reads at most SAMPLE rows, shared out evenly over the languages that have so many and in an order of hashes of
doc_id, as whole texts of any length. N-grams are counted where the rows are; the model keeps the FEATURES buckets
whose shares of documents differ most between languages, and all others as one more feature. The driver gets one vector
of FEATURES numbers for each sampled row. Scoring reads the whole texts of all rows, in blocks of places; scores are
rounded, so that the other texts of a batch don't decide their last digits.

Defined cases: ``und`` with score 0 for null texts and texts without a letter, and for all rows if nothing could be
learned. With one language learned it is predicted everywhere. doc_id null: predicted, never trained on.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import chargrams as G
from heliograph.llm import common as C

NS = (2, 3, 4)
BITS = 16
FEATURES = 4096
SAMPLE = 3_000
ROWS = 64  # texts whose n-grams are counted at once
RANGES = 16  # of buckets, in counting
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"), "slavic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "ne", "pa", "gu"), "indic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("zh", "yue"), "sinitic"),
    **dict.fromkeys(("ar", "he", "mt", "am"), "semitic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
}


def vectors(column, place: np.ndarray, features: int) -> np.ndarray:
    """The relative frequencies of the features in each text (a few texts at a time); place: bucket to feature."""
    folded, begin = G.spaced(column)
    out = np.zeros(len(column) * features, np.int64)
    for i, k in enumerate(NS):
        for doc, g in G.places(folded, begin, k, BITS):
            out += np.bincount(doc * features + place[g + (i << BITS)], minlength=len(out))
    out = out.reshape(len(column), features)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1."""
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    pw, pb = w.copy(), b
    rate = np.float32(1 / (2 * (balance * ((x * x).sum(1) + 1)).sum() + penalty))
    for t in range(steps):
        m = (t / (t + 3)) if t else 0.0
        vw, vb = w + np.float32(m) * (w - pw), b + np.float32(m) * (b - pb)
        pw, pb = w, b
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * balance * y
        w = vw - rate * (penalty * vw - 2 * (slack @ x))
        b = vb + rate * 2 * slack.sum()
    return w, float(b)


class Model:
    """Machines as columns of one weight table: one for each family, then one for each pair of languages of a family."""

    def __init__(self, place, weights, intercepts, families, languages, pairs):
        self.place, self.weights, self.intercepts = place, weights, intercepts
        self.families, self.languages, self.pairs = families, languages, pairs  # names; lists of names; (family, i, j)

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        n = len(column)
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(column.cast(pa.string()), r"\p{L}"), False)).astype(bool)
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        margin = np.zeros((n, self.weights.shape[1]))
        for lo in range(0, n if self.weights.shape[1] else 0, ROWS):
            margin[lo : lo + ROWS] = np.round(vectors(column.slice(lo, ROWS), self.place, len(self.weights)) @ self.weights + self.intercepts, 9)
        f = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :f].argmax(1) if f else np.zeros(n, np.int64)
        sure = 1 / (1 + np.exp(-2 * margin[np.arange(n), family])) if f else np.ones(n)
        names, scores = np.full(n, "und", object), np.zeros(n)
        for k, langs in enumerate(self.languages):
            rows = np.flatnonzero(letters & (family == k))
            wins, sums, least = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.ones(len(rows))
            worst = np.full((len(rows), len(langs)), np.inf)
            for c, (of, i, j) in enumerate(self.pairs):
                if of == k:
                    d = margin[rows, f + c]
                    wins[:, i] += d >= 0
                    wins[:, j] += d < 0
                    sums[:, i] += d
                    sums[:, j] -= d
                    worst[:, i] = np.minimum(worst[:, i], d)
                    worst[:, j] = np.minimum(worst[:, j], -d)
            best = (wins + 1e-3 * np.tanh(sums)).argmax(1)
            low = worst[np.arange(len(rows)), best]
            least = np.where(np.isinf(low), 1.0, 1 / (1 + np.exp(-2 * np.where(np.isinf(low), 0, low))))
            names[rows] = np.array(langs, object)[best]
            scores[rows] = sure[rows] * least
        return names.tolist(), scores


def _counted(batches):
    """Of the rows (text, lang) of one task: for each language and range of buckets, how many texts hold each."""
    size = len(NS) << BITS
    each = size // RANGES
    counts: dict[str, np.ndarray] = {}

    def rows():
        parts = [(lang, r, c[r * each : (r + 1) * each].tobytes()) for lang, c in sorted(counts.items()) for r in range(RANGES)]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.string()), pa.array([x[1] for x in parts], pa.int32()), pa.array([x[2] for x in parts], pa.binary())], ["lang", "range", "counts"])

    for whole in batches:
        for b in C.chunks(whole):
            for lang, g in zip(b.column(1).to_pylist(), G.distinct(b.column(0), NS, BITS)):
                if lang not in counts:
                    if len(counts) == 32:
                        yield rows()
                    counts[lang] = np.zeros(size, np.int32)
                counts[lang][g] += 1
    yield rows()


def spread(sizes: dict[str, int], counts: dict[str, np.ndarray]) -> np.ndarray:
    """How far the shares of documents that hold a bucket differ between languages; a little of how many hold it at all."""
    high, low, every = 0.0, np.inf if len(counts) == len(sizes) else 0.0, 0
    for lang in sorted(counts):
        share = counts[lang] / sizes[lang]
        high, low, every = np.maximum(high, share), np.minimum(low, share), every + counts[lang]
    return high - low + 1e-3 * every / sum(sizes.values())


def solve(x: np.ndarray, langs: np.ndarray, place: np.ndarray, families: dict[str, str] = FAMILIES) -> Model:
    """The machines for rows of frequencies (which are scaled in place) and their languages."""
    features = x.shape[1]
    square = sum((x[lo : lo + 256].astype(np.float64) ** 2).sum(0) for lo in range(0, len(x), 256)) / len(x)
    scale = (1 / (np.sqrt(square) + 1e-4) / np.sqrt(features)).astype(np.float32)
    x *= scale
    family_of = np.array([families.get(a, a) for a in langs], object)
    names = sorted(set(family_of))
    columns, intercepts, languages, pairs = [], [], [], []
    if len(names) > 1:
        for name in names:
            w, b = svm(x, np.where(family_of == name, 1, -1).astype(np.float32))
            columns.append(w)
            intercepts.append(b)
    for k, name in enumerate(names):
        own = sorted(set(langs[family_of == name]))
        languages.append(own)
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                rows = np.flatnonzero((langs == own[i]) | (langs == own[j]))
                w, b = svm(x[rows], np.where(langs[rows] == own[i], 1, -1).astype(np.float32))
                columns.append(w)
                intercepts.append(b)
                pairs.append((k, i, j))
    weights = np.stack(columns, 1).astype(np.float64) * scale[:, None] if columns else np.zeros((features, 0))
    return Model(place, weights, np.array(intercepts), names, languages, pairs)


def placed(top: np.ndarray, features: int) -> np.ndarray:
    """Bucket to feature: the chosen ones by number, the last for all others."""
    place = np.full(len(NS) << BITS, features - 1, np.int32)
    place[top] = np.arange(len(top))
    return place


NOTHING = Model(None, np.zeros((0, 0)), None, [], [], [])


def train(texts: pa.Array, langs: list[str], families: dict[str, str] = FAMILIES, features: int = FEATURES) -> Model:
    """From a few texts in memory."""
    if not langs:
        return NOTHING
    counts = defaultdict(lambda: np.zeros(len(NS) << BITS, np.int32))
    for i, lang in enumerate(langs):
        counts[lang][G.present(texts.slice(i, 1), NS, None, BITS)[1]] += 1
    place = placed(np.argsort(-spread(Counter(langs), counts), kind="stable")[: features - 1], features)
    x = np.concatenate([vectors(texts.slice(lo, ROWS), place, features) for lo in range(0, len(texts), ROWS)]).astype(np.float32)
    return solve(x, np.array(langs, object), place, families)


def train_stored(sample: DataFrame, families: dict[str, str] = FAMILIES, features: int = FEATURES) -> Model:
    """From rows (key, text, lang) of a stored sample."""
    sizes = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return NOTHING
    each = (len(NS) << BITS) // RANGES

    def choose(key, table):
        counts: dict[str, np.ndarray] = {}
        for lang, data in zip(table["lang"].to_pylist(), table["counts"]):
            counts[lang] = counts.get(lang, 0) + np.frombuffer(data.as_py(), np.int32)
        s = spread(sizes, counts)
        top = np.argsort(-s, kind="stable")[: features - 1]
        return pa.table({"bucket": pa.array(top + key[0].as_py() * each, pa.int64()), "spread": pa.array(s[top])})

    found = sample.select("text", "lang").mapInArrow(_counted, "lang string, range int, counts binary").groupBy("range").applyInArrow(choose, "bucket long, spread double")
    top = np.array([r.bucket for r in found.orderBy(F.desc("spread"), "bucket").limit(features - 1).collect()], np.int64)
    place = placed(top, features)

    def rows(batches):
        for whole in batches:
            for b in C.chunks(whole):
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    x = vectors(part.column(1), place, features).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "lang", "x"])

    got = sample.select("key", "text", "lang").mapInArrow(rows, "key long, lang string, x binary").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float32).reshape(-1, features).copy()
    return solve(x, np.array(got["lang"].to_pylist(), object), place, families)


def fit(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES, features: int = FEATURES) -> Model:
    """Trains on rows of docs(doc_id, text, lang) whose crc32(doc_id) modulo 3 isn't 1.

    The sample's places are shared out over at most `sample` languages (the most frequent), evenly as far as they have rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.filter((F.crc32(F.col("key").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    places, left = {}, sample
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        places[lang] = min(n, left // (len(counts) - i))
        left -= places[lang]
    # Rows beyond a hash bound that leaves twice as many are dropped where they are read.
    bounds = [(lang, n, min(1 << 32, int((2 * n + 50) / counts[lang] * (1 << 32)))) for lang, n in places.items()]
    quota = spark.createDataFrame(bounds, "lang string, places int, bound long")  # at most `sample` rows
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 32))
    near = d.join(F.broadcast(quota), "lang").withColumn("h", h).filter("h < bound")
    order = Window.partitionBy("lang").orderBy("h", "key", F.xxhash64("text"))
    chosen = near.withColumn("r", F.row_number().over(order)).filter("r <= places").select("key", "text", "lang")
    return train_stored(C.written(chosen, "languages"), families, features)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole):
                names, scores = model.predict(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
