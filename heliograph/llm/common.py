"""What the operators of this subpackage share: byte-level word arrays, hashes, partition sizing and lineage cuts.

Texts are handled as one UTF-8 byte buffer per Arrow batch with NumPy, so that a word costs a few array
operations instead of a Python object.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.session import shared_folder, spread

# The white space that separates words: space and 0x09-0x0D; every other byte belongs to a word.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Words of ASCII letters and digits and all bytes beyond ASCII (to be used on lower-cased bytes).
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: The same words as a pattern, for Spark's and Python's regular expressions alike.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_U = np.uint64
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _C1
    x ^= x >> _U(27)
    x *= _C2
    x ^= x >> _U(31)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts and the offsets of each (one more than there are texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each text (and of the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = kind[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    before[:-1] = w[1:]
    before[-1] = False
    ends = np.flatnonzero(w & (~before | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, eight bytes a step."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(buf) + 1,), (1,), writeable=False)
    lens = ends - starts
    h = lens.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    live, at = None, starts
    step = 0
    while True:
        left = (lens if live is None else lens[live]) - 8 * step
        part = eight[at] & _TAIL[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ part)
            live = np.flatnonzero(left > 8)
        else:
            h[live] = mix(h[live] ^ part)
            live = live[left > 8]
        if not len(live):
            return h
        step += 1
        at = starts[live] + 8 * step


ROLL = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(h: np.ndarray, width: int, odd: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every window of so many consecutive word hashes (windows over the bounds of texts included).

    Prefix sums run over blocks of ROLL words, so the tables of powers, which a worker keeps, have one size.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    if odd not in _powers or len(_powers[odd][0]) < ROLL + width:
        back = pow(odd, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        _powers[odd] = tuple(np.multiply.accumulate(np.concatenate([one, np.full(ROLL + width, x, np.uint64)])) for x in (odd, back))
    p, q = _powers[odd]
    out = np.empty(n - width + 1, np.uint64)
    for lo in range(0, len(out), ROLL):
        part = h[lo : lo + ROLL + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * p[: len(part)], out=total[1:])
        out[lo : lo + ROLL] = mix((total[width:] - total[:-width]) * q[: len(part) - width + 1])
    return out


def window_mask(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the windows that begin at each word stay within one text."""
    if n < width:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n - width + 1) + width <= ends[: n - width + 1]


def text_bytes(df: DataFrame) -> int:
    """The bytes of all texts as they are in memory (stored sizes say little of repetitive texts)."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(size: int, bytes_each: int, least: int = 12) -> int:
    """A number of groups that grows with the input, so that each group keeps one size."""
    return max(least, math.ceil(size / bytes_each))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers stay alive for the next stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the table documents."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, to end the lineage; it outlives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, for wide rows that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, keep: Column, n: int) -> DataFrame:
    """The n rows of the smallest hashes of doc_id among those that keep lets through.

    Rows beyond a hash bound that leaves about twice as many are dropped where they are read, so no task receives more
    than a few times n rows however many there are; the bound is widened until n rows pass or all are in.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    total, share = rows.count(), 0.0
    while True:
        share = min(1.0, share * 4 or 2 * n / max(total, 1))
        near = rows.filter((h < int(share * (1 << 32))) & keep)
        if share >= 1 or near.count() >= n:
            return near.orderBy(h, *rows.columns).limit(n)


def chunks(batch: pa.RecordBatch, limit: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text each (one text is never divided), to bound memory."""
    i = batch.schema.get_field_index(column)
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lens)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): rows (node, component), component the smallest node.

    Alternates a step to the neighbourhood's minimum with a jump to the minimum's own label; hub nodes are
    pre-aggregated by min() before the shuffle. Each round is cut by a reliable checkpoint.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("c")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = cut(step.join(up, "c", "left").select("node", "old", F.coalesce("cc", "c").alias("c")))
        changed = new.filter("c <> old").limit(1).count()
        labels = new.select("node", "c")
        if not changed:
            return labels.select("node", F.col("c").alias("component"))


def code_point_key(c: Column) -> Column:
    """Orders strings by code point (UTF-8 byte order), whatever the session's collation."""
    return F.encode(c, "UTF-8")
