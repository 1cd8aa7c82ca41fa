"""Vector functions as Columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(a: Column) -> Column:
    """L2; a zero vector stays as it is."""
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.when(s["n"] == 0, s["a"]).otherwise(F.transform(s["a"], lambda x: x / s["n"])))


def cosine(a: Column, b: Column) -> Column:
    """Within -1..1; 0 with a zero vector; an error for unequal lengths."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def hash_bucket(token: Column, dims: int = 128) -> Column:
    return F.pmod(F.crc32(token), F.lit(dims)).cast("int")


def int8_code(v: Column, low: Column, step: Column) -> Column:
    """round((x - low) / step), half to even, within 0..255."""
    scaled = F.zip_with(F.zip_with(v, low, lambda x, lo: x - lo), step, lambda d, s: d / s)
    return F.transform(scaled, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x).cast("int"))))


def int8_score(query: Column, code: Column, low: Column, step: Column) -> Column:
    """bias + sum of scaled query times code."""
    return dot(query, low) + dot(F.zip_with(query, step, lambda q, s: q * s), F.transform(code, lambda c: c.cast("double")))


def binary_code(v: Column, means: Column) -> Column:
    """Bits of x > mean, 62 to a long."""
    bits = F.zip_with(v, means, lambda x, m: F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    words = F.sequence(F.lit(0), (F.greatest(F.size(v), F.lit(1)) - 1).cast("int"), F.lit(62))
    return F.transform(words, lambda at: F.aggregate(F.transform(F.slice(bits, at + 1, F.lit(62)), lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda s, x: s + x))


def binary_similarity(a: Column, b: Column, dims: Column) -> Column:
    """1 - 2 hamming / dims."""
    return F.lit(1.0) - F.lit(2.0) * F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / dims
