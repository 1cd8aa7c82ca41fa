"""Near-duplicate classes by SetSketch registers.

1. Every text becomes the set of its word shingles (64-bit hashes). Its sketch has REGISTERS registers, each the
   exponentially spaced, truncated minimum of the set under one hash function: with x = -ln(1 - u) / A for the
   smallest hash u, the register is floor(1 - log_B x), kept within 0..LIMIT. Sketches of unions are registerwise
   maxima (mergeable), and registers of two sets are equal about as often as the sets' similarity says.
2. Texts of equal sets form a class; only its smallest doc_id goes on, so copies cost nothing further.
3. Runs of ROWS registers are bands. In each band bucket all members are compared to one centre, the member with the
   most bucket mates over all its bands (of a text and its edited copies that is the text), so a bucket of n costs
   n - 1 pairs. Pairs that the buckets' components leave unjoined come in a second round, so no link gets lost: all pairs
   of a bucket of at most BUCKET members, and for the members of larger ones the pairs that share an element of their
   prefixes of least frequency, as every linked pair does.
4. A pair's similarity is estimated by maximum likelihood jointly from the numbers of larger, smaller and equal
   registers and both set sizes. A pair is dropped here only if the threshold is worse by DROP log-likelihood.
5. All others are verified on the full shingle sets with integer arithmetic. Components of the links are the classes.

A pair at a similarity of 0.8 misses all BANDS bands with probability 3e-6, at 0.85 with 7e-9.

Defined cases: null or empty text, or one without words: the set is empty and links with nothing. Fewer words than a
shingle: the whole sequence is the only shingle. doc_id null: the row is a class of its own with component null.
Rows that share a doc_id are judged by their own texts; classes whose smallest doc_id is the same count as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm import common as C

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, A, LIMIT = 1.001, 20.0, (1 << 16) - 2
DROP = 12.5
BUCKET = 100  # members in several components, beyond which pairs come from rare elements instead
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SKETCH = "doc_id long, th long, n_shingles long, set_a long, set_b long, registers binary"


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text (A-Z lower-cased), sorted within each, and each text's bounds."""
    buf, offsets = C.texts(column)
    buf = C.LOWER[buf]
    starts, ends, first = C.words(buf, offsets)
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    h = C.word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = C.window_mask(first, len(h), width)
    long = C.rolling(h, width)[ok]
    owner = doc[: len(ok)][ok]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):  # the whole sequence, with its length, as one
        short = []
        for i in few:
            x = np.uint64(counts[i])
            for w in h[first[i] : first[i + 1]]:
                x = C.mix(np.array([x ^ w], np.uint64))[0]
            short.append(x)
        long, owner = np.r_[long, np.array(short, np.uint64)], np.r_[owner, few]
    order = np.lexsort((long, owner))
    long, owner = long[order], owner[order]
    new = np.r_[True, (long[1:] != long[:-1]) | (owner[1:] != owner[:-1])] if len(long) else np.zeros(0, bool)
    long, owner = long[new], owner[new]
    return long, np.searchsorted(owner, np.arange(len(counts) + 1))


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers for each non-empty set."""
    sizes = np.diff(bounds)
    at = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    if not len(at):
        return out
    least = np.empty((REGISTERS, len(at)), np.uint32)
    s = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    lo = 0
    while lo < len(at):  # about 64,000 elements a step stay in the cache
        hi = max(lo + 1, int(np.searchsorted(bounds[at], bounds[at[lo]] + 65536)))
        part = s[bounds[at[lo]] : bounds[at[hi - 1] + 1]]
        cuts = bounds[at[lo:hi]] - bounds[at[lo]]
        t = np.empty_like(part)
        for i in range(REGISTERS):
            np.bitwise_xor(part, _XOR[i], out=t)
            np.multiply(t, _ODD[i], out=t)
            least[i, lo:hi] = np.minimum.reduceat(t, cuts)
        lo = hi
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / A
    out[at] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def _sketches(width: int):
    def run(batches):
        for whole in batches:
            for b in C.chunks(whole):
                h, bounds = shingles(b.column(1), width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sums = np.zeros((2, len(sizes)), np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(C.mix(h), bounds[full])
                    sums[1, full] = np.add.reduceat(C.mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
                k = registers(h, bounds)
                data = pa.array([x.tobytes() if n else None for x, n in zip(k, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), data], ["doc_id", "th", "n_shingles", "set_a", "set_b", "registers"])

    return run


def _sets(width: int):
    def run(batches):
        for whole in batches:
            for b in C.chunks(whole):
                h, bounds = shingles(b.column(1), width)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "elements"])

    return run


def sketch(docs: DataFrame, width: int = 3) -> DataFrame:
    """A hash of the text, the set's size and a 128-bit digest of it, and the registers, of every row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(_sketches(width), SKETCH)


def likelihood(larger, smaller, equal, nu, nv, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of each pair, and by how much log-likelihood it beats the threshold (below it; else 0).

    With shares u and v of both sizes, registers are larger with probability p(u - v J), smaller with p(v - u J),
    where p(x) = -log_B(1 - x (B - 1) / B).
    """
    larger, smaller, equal = (np.asarray(x, np.float64)[:, None] for x in (larger, smaller, equal))
    nu, nv = np.asarray(nu, np.float64)[:, None], np.asarray(nv, np.float64)[:, None]
    u, v = nu / (nu + nv), nv / (nu + nv)
    top = np.minimum(nu, nv) / np.maximum(nu, nv)

    def p(x):
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)

    def score(j):
        a, b = p(u - v * j), p(v - u * j)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-9))

    grid = np.linspace(0, 1, 101)[None, :] * top
    s = score(grid)
    best = s.argmax(1)
    at = grid[np.arange(len(grid)), best]
    gap = s.max(1) - score(np.minimum(threshold, top)).ravel()
    gap[top.ravel() < threshold] = np.inf
    return at, np.where(at >= threshold, 0.0, gap)


def _plausible(threshold: float):
    @F.pandas_udf("boolean")
    def run(ka: pd.Series, kb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ka):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(ka), np.uint16).reshape(-1, REGISTERS)
        b = np.frombuffer(b"".join(kb), np.uint16).reshape(-1, REGISTERS)
        _, gap = likelihood((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), na, nb, threshold)
        return pd.Series(gap <= DROP)

    return run


def _bands(k: pd.Series) -> pd.Series:
    """A hash of each band, the band's number included."""
    a = np.frombuffer(b"".join(k), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), a.shape[:2]).copy()
    for i in range(ROWS):
        h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) ^ a[:, :, i])
    return pd.Series(list(h.view(np.int64)))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) of class numbers that really are linked."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"k{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {per_cent} * greatest(na, nb)")
    likely = likely.filter(_plausible(per_cent / 100)("ka", "kb", "na", "nb")).select("a", "b").distinct()
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")), "b")
    common = both.select("a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"), F.size(F.array_intersect("ea", "eb")).alias("x"))
    return common.filter(f"100L * x >= {per_cent}L * (na + nb - x)").select("a", "b").distinct()


def _prefixed(nodes: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """All pairs (a, b) of nodes(rep, c) in different components that may be linked, by rare elements instead of buckets.

    Sets of n elements that are linked share one of their n - ceil(t n) + 1 elements of least frequency: what many texts
    have in common stays out of these prefixes, so texts that are alike but not enough don't meet.
    """
    held = nodes.join(sets, nodes.rep == sets.doc_id).select("rep", "c", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = held.groupBy("e").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "e")
    prefix = held.join(often.filter("df > 1"), "e", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    prefix = prefix.withColumn("r", F.row_number().over(order)).filter(f"r <= n - ceil({per_cent} * n / 100.0D) + 1 and df > 1")
    prefix = C.cut(prefix.select("e", "rep", "c"))
    x, y = prefix.alias("x"), prefix.alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.rep") < F.col("y.rep")))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def classes_of(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, th (a hash of the text), n_shingles, component_id (the smallest doc_id of its class), links.

    Texts are linked if their shingle sets' intersection is at least so many per cent of their union; links counts
    the verified links of the row's own set that were needed to join the class (copies of equal sets not counted).
    """
    if per_cent < 80:
        raise ValueError("bands are laid out for similarities of 0.8 or more")
    all_ = C.written(sketch(docs, width), "sketches")
    known = all_.filter("n_shingles > 0 and doc_id is not null")
    # Each doc_id's class of equal sets: (set_a, set_b) grouped with its smallest doc_id as the class number.
    equal = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = C.written(equal, "classes")
    members = classes.select("rep", F.explode(F.pandas_udf(_bands, "array<long>")("registers")).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = C.cut(members.join(sizes, "bucket").select("rep", "bucket", "size"))
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "rep")
    centre = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), "rep")).alias("m")).select("bucket", F.col("m.rep").alias("centre"))
    star = shared.join(centre, "bucket").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    star = C.cut(star)
    wanted = degree.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = C.written(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, elements array<long>"), "sets")
    links = C.cut(_verified(star, classes, sets, per_cent))
    joined = C.connected(links)
    # Second round: bucket mates that the stars left in different components.
    placed = shared.join(joined, shared.rep == joined.node, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = C.cut(placed.join(mixed, "bucket"))
    per = open_.groupBy("bucket").agg(F.count("*").alias("size"))
    few = open_.join(per.filter(F.col("size") <= BUCKET), "bucket")
    x, y = few.alias("x"), few.alias("y")
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.rep") < F.col("y.rep")))
    rest = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    many = C.cut(open_.join(per.filter(F.col("size") > BUCKET), "bucket").select("rep", "c").distinct())
    if many.limit(1).count():
        rest = rest.union(_prefixed(many, sets, per_cent))
    rest = rest.distinct().join(star, ["a", "b"], "left_anti")
    more = C.cut(_verified(rest, classes, sets, per_cent))
    links = links.union(more)
    if more.limit(1).count():
        joined = C.connected(links)
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    label = classes.join(joined, classes.rep == joined.node, "left").join(ends, "rep", "left")
    label = label.select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = all_.drop("registers").join(label, ["set_a", "set_b"], "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "th", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.lit(0)).otherwise(F.col("links")).cast("long").alias("links"))


def keep_one(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows and columns of docs with one row of each class of near-duplicates: of the smallest doc_id, of its rows the first by text hash.

    Rows are judged by their own texts. Rows with a null doc_id stay, and so do texts without words.
    """
    names = docs.columns
    judged = C.written(classes_of(docs, width, per_cent).select("doc_id", "th", "n_shingles", "component_id"), "judged")
    gone = judged.filter("doc_id <> component_id").select("doc_id", "th").distinct()
    # The smallest doc_id of a class may have several rows: only its first text stays, and of equal rows one.
    own = judged.filter("doc_id = component_id and n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    first = own.groupBy("doc_id").agg(F.min("th").alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    again = C.cut(own.join(first, "doc_id").select("doc_id", "th", (F.col("th") == F.col("first")).alias("stays")))
    gone = gone.union(again.filter("not stays").select("doc_id", "th")).withColumnsRenamed({"doc_id": "_gone_id", "th": "_gone_th"})
    whole = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_th"))
    left = whole.join(gone, (F.col("_id") == F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left_anti")
    twice = again.filter("stays").select(F.col("doc_id").alias("_twice_id"), F.col("th").alias("_twice_th"))
    if twice.limit(1).count():
        on = (F.col("_id") == F.col("_twice_id")) & (F.col("_th") == F.col("_twice_th"))
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates(["_id", "_th"]))
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes_of(C.documents(spark, sf_dir, "doc_id", "text"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM d)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) JOIN documents USING (doc_id) LEFT JOIN n USING (doc_id)
"""
