"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window. The blocks form the index; every rolling
window of a block's width probes it. A repeat of a whole window contains at least one complete block of the
reference text, so no repeat can miss. Hits are extended to all windows that hold them, those windows are compared
in full (by hashes of 64 bits inside hash groups chosen by a second, independent hash), and runs of repeated
windows make up the maximal exact repeats.

Data flow: texts are packed by a hash of the row (a pack is PACK_BYTES of text, as it is in memory). A pack sends each
*distinct* probe once, as a sorted byte-packed array per hash group, so a block that a third of all documents share
costs one entry per pack, not one per document. Answers come back per pack. The exchange that packs the texts is one
subplan and is reused by the three steps that read it. No pairs of documents are ever made. Hash groups are sized by
themselves (GROUP_BYTES of text each): a message exists only for a pack's own probes, so messages never outnumber these.

Defined cases: null or empty text, or fewer words than a window: nothing is removed. doc_id null: its words are
kept, and it is no reference for others. Rows that share a doc_id don't remove each other's words. Other columns
of the input are ignored by ``spans`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm import common as C

WINDOW = 50
PACK_BYTES = 4 << 20  # of text per pack
GROUP_BYTES = 16 << 20  # of text per hash group
_NEVER = np.iinfo(np.int64).max
_CHECK = 0xA24BAED4963EE407
PROBES = "pack long, bucket int, probes binary"
ANSWERS = "pack long, hits binary"


def _packed(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences; the upper planes compress to little."""
    d = np.diff(values, prepend=values[:1])
    if len(d):
        d[0] = values[0]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _grouped(bucket: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of an array of bucket numbers in ascending order."""
    cuts = np.searchsorted(bucket, np.arange(groups + 1))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]


class _Pack:
    """Word and window hashes of one pack of texts."""

    def __init__(self, table: pa.Table, window: int):
        self.buf, offsets = C.texts(table["text"])
        self.starts, self.ends, self.first = C.words(self.buf, offsets)
        ids = table["doc_id"]
        self.known = ids.is_valid().to_numpy()
        self.doc = ids.fill_null(_NEVER).to_numpy()
        self.row = np.repeat(np.arange(len(self.doc), dtype=np.int32), np.diff(self.first))
        self.n = len(self.starts)
        self.window = window
        self.block = window // 2
        self.h = C.word_hashes(self.buf, self.starts, self.ends) if self.n else np.zeros(0, np.uint64)

    def anchors(self, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each rolling probe of a block's width, in texts that hold a window: hash group, remainder of 30 bits, start, whether a block begins there."""
        if self.n < self.window:
            return (np.zeros(0, np.int64),) * 4
        h = C.rolling(self.h, self.block)
        counts = np.diff(self.first)
        ok = C.window_mask(self.first, self.n, self.block)
        ok &= np.repeat((counts >= self.window) & self.known, counts)[: len(h)]
        at = np.flatnonzero(ok)
        h = h[at]
        return (h >> np.uint64(31)).astype(np.int64) % groups, h & np.uint64((1 << 30) - 1), at, (at - self.first[self.row[at]]) % self.block == 0

    def windows(self, at: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        h = C.rolling(self.h, self.window)[at]
        return (C.rolling(self.h, self.window, _CHECK)[at] >> np.uint64(1)).astype(np.int64) % groups, h


def _probe(window: int, groups: int):
    def run(key, table):
        group, rest, _, block = _Pack(table, window).anchors(groups)
        out: dict = {"pack": [], "bucket": [], "probes": []}
        if len(group):
            key_ = group.astype(np.uint64) << np.uint64(31) | rest << np.uint64(1)
            key_ = np.sort(key_ | ~block.astype(bool))  # the last bit is 0 at a block's start, so a block's entry sorts first
            new = np.r_[True, (key_[1:] >> np.uint64(1)) != (key_[:-1] >> np.uint64(1))]
            at = np.flatnonzero(new)
            many = np.diff(np.r_[at, len(key_)]) > 1
            k = key_[at]
            is_block = (k & np.uint64(1)) == 0
            value = ((k >> np.uint64(1)) & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2) | is_block.astype(np.uint32) << np.uint32(1) | many.astype(np.uint32)
            for b, lo, hi in _grouped((k >> np.uint64(31)).astype(np.int64), groups):
                out["pack"].append(key[0].as_py())
                out["bucket"].append(b)
                out["probes"].append(_packed(value[lo:hi]))
        return pa.table({"pack": pa.array(out["pack"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "probes": pa.array(out["probes"], pa.binary())})

    return run


def _match(key, table):
    """Of one hash group: to each pack, the probes that meet a block and occur more than once in all."""
    packs = table["pack"].to_pylist()
    each = [_unpacked(x.as_py(), np.uint32) for x in table["probes"]]
    every = np.sort(np.concatenate(each))  # equal probes stand together, whatever their flags
    value = every >> np.uint32(2)
    at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    flags = np.bitwise_or.reduceat(every & np.uint32(3), at)
    twice = (flags & np.uint32(1) > 0) | (np.diff(np.r_[at, len(value)]) > 1)
    hit = value[at][(flags & np.uint32(2) > 0) & twice]
    packs_out, hits = [], []
    for p, x in zip(packs, each):
        got = np.intersect1d(x >> np.uint32(2), hit, assume_unique=True)
        if len(got):
            packs_out.append(p)
            hits.append(np.int32(key[0].as_py()).tobytes() + got.astype(np.uint32).tobytes())
    return pa.table({"pack": pa.array(packs_out, pa.int64()), "hits": pa.array(hits, pa.binary())})


def _by_bucket(answers: pa.Table, kind: type) -> dict[int, np.ndarray]:
    return {int(np.frombuffer(x[:4], np.int32)[0]): np.frombuffer(x[4:], kind) for x in (y.as_py() for y in answers["hits"])}


def _isin(group: np.ndarray, value: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
    hit = np.zeros(len(group), bool)
    if not found:
        return hit
    order = np.argsort(group, kind="stable")
    for b, lo, hi in _grouped(group[order], int(group.max()) + 1):
        if b in found:
            hit[order[lo:hi]] = np.isin(value[order[lo:hi]], found[b])
    return hit


def _extend(window: int, groups: int):
    """Extends hits to the windows that hold them and sends those, with the smallest doc_id that this pack knows for each."""

    def run(key, table, answers):
        out: dict = {"pack": [], "bucket": [], "probes": []}
        if table.num_rows and answers.num_rows:
            p = _Pack(table, window)
            group, rest, at, _ = p.anchors(groups)
            hits = at[_isin(group, rest.astype(np.uint32), _by_bucket(answers, np.uint32))]
            ok = C.window_mask(p.first, p.n, window)
            reach = np.zeros(len(ok) + 1, np.int32)  # a hit at s lies in the windows that begin from s - (window - block) to s
            np.add.at(reach, np.clip(hits - (window - p.block), 0, len(ok)), 1)
            np.add.at(reach, np.clip(hits + 1, 0, len(ok)), -1)
            at = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & ok)
            at = at[p.known[p.row[at]]]
            group, h = p.windows(at, groups)
            doc = p.doc[p.row[at]]
            order = np.lexsort((doc, h, group))
            group, h, doc = group[order], h[order], doc[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (group[1:] != group[:-1])]) if len(h) else order
            group, h, doc = group[new], h[new], doc[new]
            for b, lo, hi in _grouped(group, groups):
                out["pack"].append(key[0].as_py())
                out["bucket"].append(b)
                out["probes"].append(h[lo:hi].tobytes() + doc[lo:hi].tobytes())
        return pa.table({"pack": pa.array(out["pack"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "probes": pa.array(out["probes"], pa.binary())})

    return run


def _settle(key, table):
    """Of one hash group: to each pack, the windows that a smaller doc_id than any of the pack's own has."""
    packs = table["pack"].to_pylist()
    raw = [x.as_py() for x in table["probes"]]
    each = [(np.frombuffer(x[: len(x) // 2], np.uint64), np.frombuffer(x[len(x) // 2 :], np.int64)) for x in raw]
    h = np.concatenate([x for x, _ in each])
    doc = np.concatenate([x for _, x in each])
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    least, value = np.minimum.reduceat(doc[order], at), h[order][at]
    packs_out, hits = [], []
    for p, (x, d) in zip(packs, each):
        got = x[least[np.searchsorted(value, x)] < d]
        if len(got):
            packs_out.append(p)
            hits.append(np.int32(key[0].as_py()).tobytes() + got.tobytes())
    return pa.table({"pack": pa.array(packs_out, pa.int64()), "hits": pa.array(hits, pa.binary())})


def removed_words(p: _Pack, answers: pa.Table, groups: int) -> np.ndarray:
    """Which words of a pack lie in a window that also begins in a document with a smaller doc_id."""
    gone = np.zeros(p.n, bool)
    if p.n < p.window:
        return gone
    at = np.flatnonzero(C.window_mask(p.first, p.n, p.window))
    at = at[p.known[p.row[at]]]
    group, h = p.windows(at, groups)
    hit = _isin(group, h, _by_bucket(answers, np.uint64))
    doc = p.doc[p.row[at]]
    order = np.lexsort((doc, h))  # within the pack: after the smallest doc_id of the same window
    ho, do = h[order], doc[order]
    if len(ho):
        run = np.cumsum(np.r_[True, ho[1:] != ho[:-1]]) - 1
        head = np.flatnonzero(np.r_[True, ho[1:] != ho[:-1]])
        hit[order] |= do > do[head][run]
    cover = np.zeros(p.n + 1, np.int64)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + p.window, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(window: int, groups: int, texts: bool):
    def run(key, table, answers):
        p = _Pack(table, window)
        gone = removed_words(p, answers, groups)
        data = p.buf.tobytes()
        kept, spans, counts, digests = [], [], [], []
        for i in range(table.num_rows):
            lo, hi = int(p.first[i]), int(p.first[i + 1])
            g = gone[lo:hi]
            counts.append(int(g.sum()))
            live = np.flatnonzero(~g) + lo
            s, e = p.starts[live].tolist(), p.ends[live].tolist()
            joined = b" ".join([data[a:b] for a, b in zip(s, e)])
            digests.append(hashlib.sha256(joined).hexdigest())
            edge = np.diff(np.r_[False, g, False].astype(np.int8))
            spans.append([{"from_word": int(a), "to_word": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(joined.decode() if texts and counts[-1] else None)
        out = {"n_words": pa.array(np.diff(p.first), pa.int64()), "n_removed": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, SPANS)}
        if texts:
            whole = table["text"].to_pylist()
            return pa.table({"doc_id": table["doc_id"], "text": pa.array([k if n else t for k, t, n in zip(kept, whole, counts)], pa.string()), "rest": table["rest"], "n_removed": out["n_removed"]})
        return pa.table({"doc_id": table["doc_id"], **out})

    return run


SPANS = pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())]))


def _trimmed(step):
    """The step, with its memory given back after each group."""

    def two(key, table):
        out = step(key, table)
        C.trim()
        return out

    def three(key, table, other):
        out = step(key, table, other)
        C.trim()
        return out

    return two if step.__code__.co_argcount == 2 else three


def _run(docs: DataFrame, window: int, texts: bool, schema: str | T.StructType) -> DataFrame:
    size = C.text_bytes(docs)
    packs, groups = C.parts(size, PACK_BYTES), C.parts(size, GROUP_BYTES)
    by = docs.withColumn("_pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs))).groupBy("_pack")
    probes = by.applyInArrow(_trimmed(_probe(window, groups)), PROBES)
    answers = probes.groupBy("bucket").applyInArrow(_trimmed(_match), ANSWERS)
    candidates = by.cogroup(answers.groupBy("pack")).applyInArrow(_trimmed(_extend(window, groups)), PROBES)
    repeats = candidates.groupBy("bucket").applyInArrow(_trimmed(_settle), ANSWERS)
    return by.cogroup(repeats.groupBy("pack")).applyInArrow(_trimmed(_finish(window, groups, texts)), schema)


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs(doc_id, text): word counts, the digest of the kept words, and the removed runs as word ranges."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<from_word:int,to_word:int>>"
    return _run(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), window, False, schema)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns with the repeated words taken out of ``text``; texts without repeats stay as they are.

    A changed text is its kept words joined by one space, and n_chars, where there is such a column, follows.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias("_"), *[docs[f"`{f.name}`"].alias(f"c{i}") for i, f in enumerate(others)])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", slim.schema["rest"].dataType), T.StructField("n_removed", T.LongType())])
    done = _run(slim, window, True, schema)
    place = {f.name: F.col(f"rest.c{i}") for i, f in enumerate(others)}
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(place["n_chars"]).cast(docs.schema["n_chars"].dataType)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return done.select(*[place.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(C.documents(spark, sf_dir, "doc_id", "text")).drop("spans")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p
), least AS (
  SELECT h, min(doc_id) AS m FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM win JOIN least USING (h) WHERE m < doc_id
), lists AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r, g,
    CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
  FROM d LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""
